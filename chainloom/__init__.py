"""chainloom: label, evaluation, audit and label-transfer analytics as Spark DataFrame plans."""
