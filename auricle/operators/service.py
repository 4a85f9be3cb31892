"""Catalogue of playable clips, payload screening and response lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import DataContractError, duplicate_keys
from .ordered import small_side, top_n


def duration_fallback(*texts: str) -> Column:
    """The first column that holds a number."""
    return F.coalesce(*[F.expr(f"try_cast(trim({t}) AS double)") for t in texts])


def catalog_allowlist(
    splits: DataFrame, ledger: DataFrame, key: str, cls: str, classes: Sequence[str], per_class: int
) -> DataFrame:
    """First ``per_class`` kept validation clips of each class in key order, with the class position.

    A repeated kept or validation id is an error.
    """
    val = splits.filter(F.col("split") == "val").select(key)
    kept = ledger.filter(F.col("status") == "kept")
    for name, rows in (("validation", val), ("kept", kept)):
        dupes = [r[0] for r in duplicate_keys(rows, [key]).select(key).limit(3).collect()]
        if dupes:
            raise DataContractError(f"duplicate {name} ids: {dupes}")
    pool = kept.join(val, key, "left_semi").filter(F.col(cls).isin(*classes))
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(cls)) - 1
    return top_n(pool, [cls], [F.col(key)], per_class, [key]).withColumn("class_position", position.cast("int"))


def payload_screen(data: str, duration: str, max_bytes: int, max_seconds: float) -> Column:
    """Why an uploaded base64 WAV is refused, null when it is accepted.

    Size and header follow from the text length and its first 16 characters, so a large
    payload is never decoded as a whole.
    """
    text = F.col(data)
    size = F.octet_length(text)
    valid = (size % 4 == 0) & text.rlike(r"^[A-Za-z0-9+/]*={0,2}\z")
    padding = F.when(text.endswith("=="), 2).when(text.endswith("="), 1).otherwise(0)
    n_bytes = size / 4 * 3 - padding
    head = F.hex(F.when(valid, F.unbase64(F.substring(data, 1, 16))))
    return (
        F.when(text.isNull() | (text == ""), "data is required")
        .when(~valid, "invalid base64 data")
        .when(n_bytes > max_bytes, f"file too large (limit {max_bytes} bytes)")
        .when(n_bytes < 12, "invalid WAV file: too short")
        .when(~F.startswith(head, F.lit("52494646")), "invalid WAV file: missing RIFF header")
        .when(F.substring(head, 17, 8) != "57415645", "invalid WAV file: missing WAVE signature")
        .when(F.col(duration) > max_seconds, f"file too long (limit {max_seconds:g}s)")
    )


def _base64_hex(text: Column, at: Column, n: int) -> Column:
    """Hex digits of ``n`` bytes from byte ``at`` on; only the characters that hold them are decoded."""
    first = F.floor(at / 3) * 4 + 1
    part = F.hex(F.unbase64(F.substr(text, first.cast("int"), F.lit(-(-(n + 2) // 3) * 4))))
    return F.substr(part, (at % 3 * 2 + 1).cast("int"), F.lit(2 * n))


def _little_endian(digits: Column, at: int, n: int) -> Column:
    """The unsigned number in bytes ``at`` to ``at + n`` of hex digits."""
    pairs = [F.substring(digits, 2 * (at + k) + 1, 2) for k in reversed(range(n))]
    return F.conv(F.concat(*pairs), 16, 10).cast("bigint")


# The names of a WAV file's format and data chunks, in hex.
FORMAT_CHUNK, DATA_CHUNK = "666D7420", "64617461"


def wav_header(text: Column, n_bytes: Column, max_chunks: int = 64) -> Column:
    """Struct (``seconds``, ``problem``) from the chunks of a WAV file in base64; exactly one of both is null.

    The chunks are walked from byte 12 on: a name, a little-endian size, that many bytes and one more if the size is
    odd. The format chunk gives bytes per frame and frames per second, the data chunk the bytes of sound. Each step
    decodes a few characters where the chunk begins, so neither the sound nor a large chunk before it is decoded. A file
    whose data comes after more than ``max_chunks`` chunks is refused.
    """
    text_type, none = "string", F.lit(None)

    def state(at, align, rate, seconds, problem) -> Column:
        return F.struct(
            at.cast("bigint").alias("at"),
            align.cast("bigint").alias("align"),
            rate.cast("bigint").alias("rate"),
            seconds.cast("double").alias("seconds"),
            problem.cast(text_type).alias("problem"),
        )

    def refuse(acc: Column, why: str) -> Column:
        return state(acc["at"], acc["align"], acc["rate"], none, F.lit(f"invalid WAV file: {why}"))

    def step(acc: Column, _) -> Column:
        at = acc["at"]
        head = _base64_hex(text, at, 8)
        name, size = F.substring(head, 1, 8), _little_endian(head, 4, 4)
        ends = at + 8 + size
        form = _base64_hex(text, at + 8, 16)
        rate, align = _little_endian(form, 4, 4), _little_endian(form, 12, 2)
        onward = ends + size % 2
        sound = F.floor(size / acc["align"]) / acc["rate"]
        return (
            F.when(acc["seconds"].isNotNull() | acc["problem"].isNotNull(), acc)
            .when(at + 8 > n_bytes, refuse(acc, "no data chunk"))
            .when(ends > n_bytes, refuse(acc, "truncated chunk"))
            .when((name == FORMAT_CHUNK) & (size < 16), refuse(acc, "broken format chunk"))
            .when((name == FORMAT_CHUNK) & ((rate == 0) | (align == 0)), refuse(acc, "broken format chunk"))
            .when(name == FORMAT_CHUNK, state(onward, align, rate, none, none))
            .when((name == DATA_CHUNK) & acc["rate"].isNull(), refuse(acc, "no format chunk"))
            .when(name == DATA_CHUNK, state(at, acc["align"], acc["rate"], sound, none))
            .otherwise(state(onward, acc["align"], acc["rate"], none, none))
        )

    steps = F.sequence(F.lit(1), F.lit(max_chunks))
    walked = F.aggregate(steps, state(F.lit(12), none, none, none, none), step)
    late = walked["seconds"].isNull() & walked["problem"].isNull()
    problem = F.when(late, "invalid WAV file: too many chunks").otherwise(walked["problem"])
    return F.struct(walked["seconds"].alias("seconds"), problem.alias("problem"))


def screen_wav(rows: DataFrame, data: str, max_bytes: int, max_seconds: float) -> DataFrame:
    """Adds ``seconds``, the duration by the file's own header, and ``reason``, why the upload is refused (null when it
    is accepted). A header that cannot be read is a reason of its own; text that is not base64, too large or no WAV
    file is not walked."""
    text = F.col(data)
    padding = F.when(text.endswith("=="), 2).when(text.endswith("="), 1).otherwise(0)
    sized = rows.withColumn("_bytes", (F.octet_length(text) / 4 * 3 - padding).cast("bigint"))
    first = sized.withColumn("_none", F.lit(None).cast("double"))
    first = first.withColumn("_reason", payload_screen(data, "_none", max_bytes, max_seconds))
    walked = first.withColumn("_wav", F.when(F.col("_reason").isNull(), wav_header(text, F.col("_bytes"))))
    long = F.when(F.col("_wav.seconds") > max_seconds, f"file too long (limit {max_seconds:g}s)")
    out = {"seconds": F.col("_wav.seconds"), "reason": F.coalesce("_reason", F.col("_wav.problem"), long)}
    return walked.withColumns(out).drop("_bytes", "_none", "_reason", "_wav")


def attach_response(rows: DataFrame, responses: DataFrame, label: str) -> DataFrame:
    return rows.join(small_side(responses.withColumnRenamed("class_name", label)), label, "left")


def response_coverage(responses: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Classes without a response and responses for unknown classes."""
    classes = taxonomy.select("class_name")
    missing = classes.join(responses, "class_name", "left_anti").withColumn("problem", F.lit("missing"))
    unknown = responses.select("class_name").join(classes, "class_name", "left_anti").withColumn("problem", F.lit("unknown"))
    return missing.unionByName(unknown)
