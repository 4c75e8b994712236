"""Column expressions on text: tokens, headings, tags, scaling."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as Python's str methods see it; heading patterns and the confidence tag in Python's syntax.
SPACE = r"[\s\x1c-\x1f]"
HEADINGS = (
    r"^\d+(\.\d+)*\s{1,4}\S",
    r"^[A-Z][A-Z0-9\-\.]*(?:\s+[A-Z0-9\-\.]+){1,10}$",
    r"^[A-Z][a-zA-Z\s]{2,60}:$",
)
TAG = r"<confidence>\s*(\d+)\s*</confidence>"


def java(pattern: str) -> str:
    """A Python pattern in Java's syntax: Unicode classes, Python's white space, and ``$`` only at the end."""
    same = {r"\s": SPACE, r"\S": r"[^\s\x1c-\x1f]", "$": r"\n?\z"}
    return "(?U)" + re.sub(r"\\[sS]|\$", lambda m: same[m[0]], pattern)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def words(text: Column) -> Column:
    """White-space words; none for a blank or null text."""
    return F.filter(F.split(strip(F.coalesce(text, F.lit(""))), rf"(?U){SPACE}+"), lambda w: w != "")


def token_count(text: Column) -> Column:
    """A quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4).cast("int"))


def chunk_id(doc_name: Column, path: Column, index: Column) -> Column:
    """First 16 hex digits of the SHA-1 of document, section path and index, joined by bars."""
    return F.substring(F.sha1(F.concat_ws("|", doc_name, F.array_join(path, "|"), index.cast("string")).cast("binary")), 1, 16)


def is_heading(text: Column, size: Column, median: Column, most: int = 120, ratio: float = 1.15) -> Column:
    """By font size where both sizes are known, else by pattern; blank and long lines are none."""
    t = strip(text)
    by_size = F.coalesce((size > 0) & (median > 0) & (size >= median * ratio), F.lit(False))
    by_text = reduce(Column.__or__, [t.rlike(java(p)) for p in HEADINGS])
    return F.when(F.length(t).between(1, most), by_size | by_text).otherwise(False)


def confidence(text: Column) -> Column:
    """First whole number in a confidence tag, 0 to 100; 50 without one."""
    digits = F.regexp_extract(text, f"(?i){java(TAG)}", 1)
    return F.when(digits == "", 50).when(F.length(digits) > 9, 100).otherwise(F.least(F.lit(100), F.coalesce(digits.try_cast("int"), F.lit(50))))


def without_tag(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"(?i){java(TAG)}", ""), rf"(?U){SPACE}+\z", "")


def window_words(most: int, overlap: int) -> tuple[int, int]:
    """Words of a window and from one window's start to the next; four words are taken for five tokens."""
    width, shared = max(1, int(most * 0.8)), max(0, int(overlap * 0.8))
    if shared >= width:
        raise ValueError("overlap must be smaller than the window")
    return width, width - shared


def windows(text: Column, most: int = 512, overlap: int = 64) -> Column:
    """A text of at most ``most`` tokens unchanged, else its overlapping runs of words, joined by blanks.

    The words are bound once as a lambda's argument, so the split isn't evaluated again for every window."""
    width, step = window_words(most, overlap)

    def cut(w):
        n = F.when(F.size(w) <= width, 1).otherwise(F.ceil((F.size(w) - width) / step).cast("int") + 1)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(w, i * step + 1, F.lit(width)), " "))

    whole = (token_count(text) <= most) | (strip(text) == "")
    return F.when(whole, F.array(text)).otherwise(F.flatten(F.transform(F.array(words(text)), cut)))


def platt(raw: Column, coef: float, intercept: float) -> Column:
    """Calibrated probability of a raw 0-100 confidence."""
    return 1 / (1 + F.exp(-(coef * raw / 100 + intercept)))


def action(conf: Column, refuse: float = 0.70, notice: float = 0.85) -> Column:
    """refuse, notice or answer; both bounds are inclusive below. Unknown confidence refuses."""
    unsure = conf.isNull() | F.isnan(conf.cast("double"))
    return F.when(unsure | (conf < refuse), "refuse").when(conf < notice, "notice").otherwise("answer")


#: The lower bounds of the actions as the serving code has them, and the four actions of its documents.
POLICY = {"answer": 0.85, "notice": 0.70}
DOCUMENTED_POLICY = {"answer": 0.85, "caveat": 0.65, "verify": 0.45}


def policy_action(conf: Column, policy: dict[str, float]) -> Column:
    """The action of the highest bound that the confidence reaches; below all bounds, or unknown: refuse."""
    out = F.lit("refuse")
    for name, bound in sorted(policy.items(), key=lambda x: x[1]):
        out = F.when((conf >= bound) & ~F.isnan(conf.cast("double")), name).otherwise(out)
    return out


def guarded(answer: Column, conf: Column, refusal: str, notice: str) -> Column:
    """Struct (answer, refused): the answer, the answer with the notice below, or the refusal in its place."""
    what = action(conf)
    text = F.when(what == "refuse", refusal).when(what == "notice", F.concat(F.regexp_replace(answer, rf"(?U){SPACE}+\z", ""), F.lit("\n\n" + notice))).otherwise(answer)
    return F.struct(text.alias("answer"), (what == "refuse").alias("refused"))
