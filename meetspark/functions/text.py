"""Scalar expressions on texts, times and ids. All are built-in functions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default phrases by which a model puts a stamp in front of its answer; a parameter of all that look for them.
STAMPS = ("in this segment", "this chapter", "the speaker", "here is")


def _text(t: Column) -> Column:
    return F.coalesce(t, F.lit(""))


def is_blank(t: Column) -> Column:
    """Null, empty or white space only."""
    return F.trim(F.regexp_replace(_text(t), r"\s+", " ")) == ""


def word_count(t: Column) -> Column:
    """Number of runs between white space; 0 for a blank text."""
    return F.size(F.filter(F.split(_text(t), r"\s+"), lambda x: x != ""))


def format_clock(sec: Column) -> Column:
    """``h:mm:ss`` from an hour on, else ``mm:ss``; fractions are cut off."""
    s = F.floor(sec).cast("long")
    h, m = F.floor(s / 3600).cast("long"), F.pmod(F.floor(s / 60).cast("long"), F.lit(60))
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, F.pmod(s, F.lit(60)))).otherwise(F.format_string("%02d:%02d", m, F.pmod(s, F.lit(60))))


def format_mmss(sec: Column) -> Column:
    """``mm:ss`` where minutes may pass 59."""
    s = F.floor(sec).cast("long")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)))


def normalize_text(t: Column) -> Column:
    """Lower case, ``ё`` as ``е``, everything but letters, digits and ``_`` as one space."""
    return F.trim(F.regexp_replace(F.translate(F.lower(_text(t)), "ё", "е"), r"[^\p{L}\p{N}_]+", " "))


def tokens(t: Column, min_len: int = 2) -> Column:
    """Words of the normalised text of ``min_len`` characters or more, in order."""
    return F.filter(F.split(normalize_text(t), " "), lambda x: F.length(x) >= min_len)


def latin_chars(t: Column) -> Column:
    return F.length(_text(t)) - F.length(F.regexp_replace(_text(t), "[a-zA-Z]", ""))


def starts_with_stamp(t: Column, stamps: tuple[str, ...] = STAMPS, strip_quotes: bool = True) -> Column:
    bare = F.lower(F.regexp_replace(_text(t), r"^[\s«\"'(\[{`]+", "") if strip_quotes else F.trim(_text(t)))
    return F.exists(F.array(*map(F.lit, stamps)), lambda p: bare.startswith(p))


def digit_groups_verified(t: Column, source: Column) -> Column:
    """Every run of digits of ``t`` is somewhere in ``source``."""
    return F.forall(F.filter(F.split(_text(t), r"[^0-9]+"), lambda x: x != ""), lambda g: F.contains(_text(source), g))


def clean(t: Column, most: int) -> Column:
    """White space squeezed, at most ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(_text(t), r"\s+", " ")), 1, most)


def clean_alias(t: Column) -> Column:
    return clean(t, 80)


def clean_title(t: Column) -> Column:
    return clean(t, 120)


def display_name(speaker: Column, alias: Column) -> Column:
    """``alias · id``, or the id alone without an alias."""
    return F.when(clean_alias(alias) == "", speaker).otherwise(F.concat_ws(" · ", clean_alias(alias), speaker))


def hash_client(ip: Column, salt: str) -> Column:
    if not salt:
        raise ValueError("a salt is required")
    return F.sha2(F.concat_ws(":", F.lit(salt), ip), 256)


def _local(name: Column) -> Column:
    host = F.regexp_replace(F.regexp_replace(F.lower(F.trim(_text(name))), r"^\[(.*)\](:\d+)?$", "$1"), r"^::ffff:", "")
    host = F.regexp_replace(host, r"^([^:]+):\d+$", "$1")
    return host.isin("localhost", "::1") | host.rlike(r"^127\.\d{1,3}\.\d{1,3}\.\d{1,3}$")


def is_loopback(ip: Column, host: Column | None = None) -> Column:
    """Whether the address, or the host that was asked for, is this machine's: 127.0.0.0/8, ``::1``, mapped addresses, ``localhost``; brackets and
    ports do not matter, nulls are not."""
    return _local(ip) if host is None else _local(ip) | _local(host)


def gain_plan(rms: Column, peak: Column, threshold: float = -30.0, target: float = -23.0, most: float = 18.0, ceiling: float = -1.0) -> Column:
    """Gain to bring a quiet recording to the target without passing the peak ceiling: struct ``gain_db, applied, capped``."""
    raw = F.lit(target) - rms
    gain = F.when(rms >= threshold, 0.0).otherwise(F.greatest(F.lit(0.0), F.round(F.least(raw, F.lit(most), F.lit(ceiling) - peak), 3)))
    return F.struct(gain.alias("gain_db"), (gain > 0).alias("applied"), ((gain > 0) & (raw > most)).alias("capped"))


def size_check(size: Column, max_mb: float | None) -> Column:
    """Accepted? A file of exactly the limit is; without a limit all are."""
    return F.lit(True) if max_mb is None else size <= max_mb * 1024 * 1024


def duration_trim(sec: Column, max_min: float | None) -> Column:
    """Seconds to cut a longer recording to; null where it is not cut."""
    return F.lit(None).cast("double") if max_min is None else F.when(sec > max_min * 60, F.lit(max_min * 60.0))


def trim_decision(sec: Column, max_min: float | None) -> Column:
    """Struct ``will_trim, trim_to_sec`` of a recording's length: one of exactly the limit stays whole."""
    to = duration_trim(sec, max_min)
    return F.struct(to.isNotNull().alias("will_trim"), to.alias("trim_to_sec"))


def loudness(n: Column, sum_sq: Column, max_abs: Column) -> tuple[Column, Column]:
    """Aggregates ``rms_dbfs, peak_dbfs`` over frames of ``n`` samples with their sums of squares and largest magnitudes; -100 for none or
    silence."""
    count, power, peak = F.sum(n), F.sum(sum_sq), F.max(max_abs)
    rms = F.when((count > 0) & (power > 0), 20 * F.log10(F.sqrt(power / count))).otherwise(-100.0)
    return rms.alias("rms_dbfs"), F.when(peak > 0, 20 * F.log10(peak)).otherwise(-100.0).alias("peak_dbfs")


def title_error(title: Column, taken: Column, max_words: int = 10) -> Column:
    """Why a title can't be used, null if it can: ``empty``, ``long`` (more words than ``max_words``), ``stamp`` (starts with a time), ``duplicate``
    (``taken`` is true), in this order."""
    return F.when(is_blank(title), "empty").when(word_count(title) > max_words, "long").when(starts_with_stamp(title, strip_quotes=False), "stamp").when(taken, "duplicate")


def number_id(prefix: str, width: int, n: Column) -> Column:
    return F.format_string(f"{prefix}%0{width}d", n.cast("long"))
