"""Masks and the records of what was masked."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.folding import bind, fold
from ..schema import MaskStyle, Options

LOG = "struct<start:int,end:int,label:string,score:double,source:string,substr:string,before_hash:string,after:string>"
# The alphabet, shortest and longest random mask, digits of a hash mask.
ALPHABET, SHORTEST, LONGEST, HASH_DIGITS = "ABCDEFGHJKLMNPQRSTUVWXYZ23456789", 6, 24, 12
SEED = "12345"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def random_mask(fragment: Column, key: Column) -> Column:
    """Letters drawn by a hash of the seed and key, as long as the fragment within the bounds."""
    code = sha(F.concat(F.lit(SEED + ":"), key))
    size = F.least(F.greatest(F.length(fragment), F.lit(SHORTEST)), F.lit(LONGEST))
    letter = lambda i: F.lit(ALPHABET).substr(F.conv(code.substr(2 * i + 1, F.lit(2)), 16, 10).cast("int") % len(ALPHABET) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), size - 1), letter), "")


def mask(label: Column, fragment: Column, options: Options, key: Column, salt: str) -> Column:
    style = options.mask_style
    if style == MaskStyle.TAG:
        out = F.concat(F.lit("[[ENTITY:"), label, F.lit("]]"))
    elif style == MaskStyle.HASH:
        out = sha(F.concat(F.lit(salt), fragment)).substr(1, HASH_DIGITS)
    elif style == MaskStyle.RANDOM:
        out = random_mask(fragment, key)
    else:
        out = F.repeat(F.lit("*"), F.greatest(F.length(fragment), F.lit(1)))
    return F.rpad(out, F.length(fragment), F.lit("*")) if options.keep_length else out


def masked(text: Column, spans: Column, options: Options = Options(), key: Column | None = None, salt: str | None = None) -> Column:
    """struct<redacted, logs>. Spans in order; one that begins before the last one's end is left out. The salt is read on the driver."""
    salt = os.environ.get(options.salt_env, "") if salt is None else salt
    key = F.coalesce(key.cast("string"), F.lit("")) if key is not None else F.lit("")
    none = F.struct(F.lit(None).cast("string").alias("redacted"), F.array().cast(f"array<{LOG}>").alias("logs"))
    ordered = F.array_sort(spans)  # by start, then end
    # A chunk's own stretch of the text is cut out once; to cut each span out of the whole text would read it from its beginning each time.
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("base"), F.lit("").alias("piece"))

    def enter(state: Column, chunk: Column) -> Column:
        last = F.greatest(state["at"], F.array_max(F.transform(chunk, lambda s: s["end"])))
        return F.struct(state["at"].alias("at"), state["at"].alias("base"), text.substr(state["at"] + 1, last - state["at"]).alias("piece"))

    def step(state: Column, out: Column, s: Column) -> tuple[Column, Column]:
        cut = lambda start, end: state["piece"].substr(start - state["base"] + 1, end - start)

        def taken(fragment: Column) -> Column:
            after = mask(s["label"], fragment, options, F.concat_ws(":", key, s["start"].cast("string")), salt)
            record = F.struct(
                s["start"].alias("start"),
                s["end"].alias("end"),
                F.coalesce(s["labels_joined"], s["label"]).alias("label"),
                s["score"].alias("score"),
                s["source"].alias("source"),
                fragment.alias("substr"),
                sha(F.concat(F.lit(salt), fragment)).alias("before_hash"),
                after.alias("after"),
            )
            return F.struct(cut(state["at"], s["start"]).alias("between"), record.alias("log"))

        free = s["start"] >= state["at"]
        gathered = F.when(free, F.array_append(out, bind(cut(s["start"], s["end"]), taken))).otherwise(out)
        return F.struct(F.when(free, s["end"]).otherwise(state["at"]).alias("at"), state["base"].alias("base"), state["piece"].alias("piece")), gathered

    def finish(state: Column, out: Column) -> Column:
        woven = F.array_join(F.flatten(F.transform(out, lambda x: F.array(x["between"], x["log"]["after"]))), "")
        rest = text.substr(state["at"] + 1, F.length(text))
        return F.struct(F.concat(woven, rest).alias("redacted"), F.transform(out, lambda x: x["log"]).alias("logs"))

    return F.when(text.isNotNull(), fold(ordered, begin, f"struct<between:string,log:{LOG}>", step, finish, enter)).otherwise(none)
