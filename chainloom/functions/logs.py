"""Column builders for run names, command lines and run logs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parts of a run's name, and the column that each gives.
NAME_PARTS = {"arch": "architecture", "hd": "hidden_dims", "drop": "dropout", "norm": "head_norm", "act": "activation", "lr": "learning_rate", "wd": "weight_decay", "bs": "batch_size", "fold": "cv_fold", "seed": "seed", "version": "version"}
# What a line of the error stream says if it is an error, in any case.
ERROR_WORDS = r"(?i)\b(traceback|runtimeerror|valueerror|assertionerror|keyerror|indexerror|typeerror|exception|slurmstepd: error|segmentation fault|killed|out of memory|oom|cuda error|failed)\b"
# Lines of a run's output.
SUMMARY = r"\[SUMMARY\]\s+(?i:{subset})\s+AUCPR=([0-9]*\.?[0-9]+)"
DONE = r"--- DONE in ([0-9]*\.?[0-9]+) h ---"
RUNNING_ROW = r"\[INFO\]\s+Running row\s+(\d+)/(\d+)"
CSV_PATH = r"\[INFO\]\s+CSV_PATH=(\S+)"
SKIP_PATH = r"\[SKIP\]\s+Existing run found:\s*(\S+)"
OUT_DIR = r"\[INFO\]\s+OUT_DIR=(\S+)"
TRACEBACK = "Traceback (most recent call last):"
SNIPPET_LINES = 12


def _text(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.get(F.regexp_extract_all(_text(text), F.lit(pattern), F.lit(group)), 0)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once a row: inside functions of arrays, an expression that is named twice is worked out twice, for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def last_of_each(entries: Column) -> Column:
    """A map of (key, value) structs in which the last of a key counts."""
    later = lambda all_, i: F.slice(all_, i + 2, F.greatest(F.size(all_), F.lit(1)))
    return _once(entries, lambda all_: F.map_from_entries(F.filter(all_, lambda e, i: ~F.exists(later(all_, i), lambda x: x["key"] == e["key"]))))


def _entry(key: Column, value: Column) -> Column:
    return F.struct(key.alias("key"), value.alias("value"))


def normal_list(text: Column) -> Column:
    """Parts between blanks, commas and dashes, joined by dashes; null, blank and nan are ""."""
    clean = F.trim(_text(text))
    return F.when(F.lower(clean) == "nan", "").otherwise(F.array_join(F.filter(F.split(clean, r"[\s,\-]+"), lambda p: p != ""), "-"))


def run_name(model: Column, esm2_version: Column, esm2_layer: Column, fields: dict[str, Column]) -> Column:
    """model__version__layerN__k=v__...: fields by the short names of NAME_PARTS, as text, blanks of lists as dashes; null ones are left out."""
    parts = [model, esm2_version, F.concat(F.lit("layer"), esm2_layer.cast("string"))]
    parts += [F.concat(F.lit(f"{k}="), F.replace(v.cast("string"), F.lit(" "), F.lit("-")) if k == "hd" else v.cast("string")) for k, v in fields.items()]
    return F.array_join(F.array_compact(F.array(*parts)), "__")


def run_fields(path: Column) -> Column:
    """map<field, value> of a run folder's name: model_name is the first part, esm2_version and esm2_layer are known by how they begin, others by "k=".

    Parts that say nothing known are passed over; of a repeated field the last counts. A null or empty name gives an empty map.
    """
    parts = F.split(F.element_at(F.split(F.rtrim(_text(path), F.lit("/")), "/"), -1), "__")
    named = F.create_map(*[F.lit(x) for pair in NAME_PARTS.items() for x in pair])

    def read(p: Column, i: Column) -> Column:
        value = F.substring_index(p, "=", -1)
        value = F.when(F.contains(p, F.lit("=")), F.substr(p, F.instr(p, "=") + 1)).otherwise(value)
        key = F.substring_index(p, "=", 1)
        field = F.when(F.contains(p, F.lit("=")), F.element_at(named, key))
        other = F.when(p.startswith("esm2_"), _entry(F.lit("esm2_version"), p)).when(p.rlike(r"^layer\d+$"), _entry(F.lit("esm2_layer"), F.substr(p, F.lit(6))))
        return F.when(i == 0, F.when(p != "", _entry(F.lit("model_name"), p))).when(other.isNotNull(), other).when(field.isNotNull(), _entry(field, F.when(field == "hidden_dims", normal_list(value)).otherwise(value)))

    return last_of_each(F.filter(F.transform(parts, read), lambda e: e.isNotNull()))


#: A word of a command line: plain letters, quoted stretches, escaped letters.
_WORD = r"""(?:[^\s"'\\]|\\.|"(?:[^"\\]|\\.)*"|'[^']*')++"""


def command_flags(text: Column) -> Column:
    """map<flag, value> of the first line that begins with [CMD], with the line itself as cmd: a bare flag is "true", a flag has one value, hidden_dims all up to the next flag, joined by dashes.

    Words are split as a shell does: quotes and backslashes hold them together and go (inside double quotes a backslash stays). If quotes do not close, only cmd is given.
    Of a repeated flag the last counts. No such line gives an empty map.
    """
    return _once(F.trim(_found(text, r"(?m)^\[CMD\]\s+(.*)$")), lambda line: _once(_shell_words(line), lambda words: last_of_each(_flags(line, words))))


def _shell_words(line: Column) -> Column:
    """The words of a line without quotes and backslashes; none if a quote does not close."""
    whole = line.rlike(rf"^(?:\s*+{_WORD})*+\s*+$")  # possessive: an open quote fails at once
    words = F.when(whole, F.regexp_extract_all(line, F.lit(_WORD), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(words, lambda w: F.regexp_replace(w, r""""((?:[^"\\]|\\.)*)"|'([^']*)'|\\(.)""", "$1$2$3"))


def _flags(line: Column, words: Column) -> Column:
    """(key, value) structs: the line as cmd, then its flags in order; none for a null line."""

    def read(flags_at: Column) -> Callable[[Column, Column], Column]:
        def one(at: Column, n: Column) -> Column:
            key = F.substr(F.get(words, at), F.lit(3))
            end = F.coalesce(F.get(flags_at, n + 1), F.size(words))
            values = F.slice(words, at + 2, F.greatest(end - at - 1, F.lit(0)))
            return _entry(key, F.when(key == "hidden_dims", normal_list(F.array_join(values, " "))).when(F.size(values) == 0, "true").otherwise(F.get(values, 0)))

        return one

    flags_at = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit("--")), i)), lambda i: i.isNotNull())
    flags = _once(flags_at, lambda places: F.transform(places, read(places)))
    none = F.array().cast("array<struct<key:string,value:string>>")
    return F.when(line.isNull(), none).otherwise(F.concat(F.array(_entry(F.lit("cmd"), line)), flags))


def aucpr(out: Column, subset: str) -> Column:
    """The last value that the output's summary lines give for a subset; null without one."""
    return F.try_element_at(F.regexp_extract_all(_text(out), F.lit(SUMMARY.format(subset=subset)), F.lit(1)), F.lit(-1)).cast("double")


def log_status(out: Column, err: Column) -> Column:
    """skipped, else success (failed with a traceback) if done or with a validation or test summary, else failed with a traceback or error words on the error stream, else incomplete."""
    out, err = _text(out), _text(err)
    traceback = F.contains(out, F.lit(TRACEBACK)) | F.contains(err, F.lit(TRACEBACK))
    finished = out.rlike(DONE) | aucpr(out, "validation").isNotNull() | aucpr(out, "test").isNotNull()
    return F.when(F.contains(out, F.lit("[SKIP]")), "skipped").when(finished & traceback, "failed").when(finished, "success").when(traceback | err.rlike(ERROR_WORDS), "failed").otherwise("incomplete")


def error_snippet(out: Column, err: Column, lines: int = SNIPPET_LINES) -> Column:
    """The last lines of the error stream that are not blank, if it has error words; else the output from its last traceback on; else ""."""
    rows = lambda text: F.split(_text(text), "\r\n|\n|\r")
    said = F.filter(rows(err), lambda x: F.trim(x) != "")
    o = rows(F.regexp_replace(_text(out), r"(\r\n|\n|\r)\z", ""))
    at = F.array_max(F.transform(o, lambda x, i: F.when(F.contains(x, F.lit(TRACEBACK)), i)))
    last = F.array_join(F.slice(said, F.greatest(F.size(said) - lines + 1, F.lit(1)), lines), "\n")
    return F.when(_text(err).rlike(ERROR_WORDS), last).when(at.isNotNull(), F.array_join(F.slice(o, at + 1, lines), "\n")).otherwise("")


def log_metrics(out: Column, err: Column | None = None) -> Column:
    """struct of a run's log: csv_path, row_idx_1based, row_total, run_dir (of a skipped run, else the output folder), train, validation and test AUCPR (last summary), done_hours, status, error_snippet."""
    err = F.lit("") if err is None else err
    return F.struct(
        _found(out, CSV_PATH).alias("csv_path"), _found(out, RUNNING_ROW).cast("long").alias("row_idx_1based"), _found(out, RUNNING_ROW, 2).cast("long").alias("row_total"),
        F.coalesce(_found(out, SKIP_PATH), _found(out, OUT_DIR)).alias("run_dir"), *[aucpr(out, s).alias(f"{s}_aucpr") for s in ("train", "validation", "test")],
        _found(out, DONE).cast("double").alias("done_hours"), log_status(out, err).alias("status"), error_snippet(out, err).alias("error_snippet"),
    )
