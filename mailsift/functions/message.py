"""Message-level expressions: serving text, defaults, sender domains."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import NO_SUBJECT
from .text import strip_ws


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _s(col: Column | str) -> Column:
    return strip_ws(F.coalesce(_c(col), F.lit("")))


def serving_text(subject: Column | str, sender: Column | str, body: Column | str) -> Column:
    """Three labelled lines, fields stripped, then the whole stripped."""
    text = F.concat(F.lit("Subject: "), _s(subject), F.lit("\nFrom: "), _s(sender),
                    F.lit("\nBody: "), _s(body))
    return strip_ws(text)


def compose_text(*cols: Column) -> Column:
    """Parts joined by one blank, then stripped (parts are cleaned first)."""
    return strip_ws(F.concat_ws(" ", *cols))


def default_subject(col: Column | str) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(c == "", F.lit(NO_SUBJECT)).otherwise(c)


def default_message_id(col: Column | str, uid: Column | str) -> Column:
    c = F.coalesce(_c(col), F.lit(""))
    return F.when(c == "", _c(uid).cast("string")).otherwise(c)


def message_body(col: Column | str, limit: int | None = None) -> Column:
    """The whole body, a null one empty; ``limit`` (BODY_LIMIT is the original's)
    cuts it to so many characters."""
    whole = F.coalesce(_c(col), F.lit(""))
    return whole if limit is None else F.substring(whole, 1, limit)


def sender_domain(col: Column | str) -> Column:
    """Domain of a sender: use the <...> part when both brackets occur
    (first '<' to first '>'), then the text after the last '@', else ''."""
    s = F.lower(_s(col))
    lt = F.instr(s, "<")
    gt = F.instr(s, ">")
    inner = strip_ws(F.substring(s, lt + 1, F.greatest(gt - lt - 1, F.lit(0))))
    addr = F.when((lt > 0) & (gt > 0), inner).otherwise(s)
    return F.when(F.instr(addr, "@") > 0,
                  strip_ws(F.substring_index(addr, "@", -1))).otherwise(F.lit(""))


def base_domain(col: Column | str) -> Column:
    """Last two dot-separated labels (no public-suffix table: a.co.uk -> co.uk)."""
    return F.substring_index(F.coalesce(_c(col), F.lit("")), ".", -2)


def registered_domain(col: Column | str, rules: Iterable[str]) -> Column:
    """The domain that somebody registered: the public suffix and one label more;
    '' for a public suffix itself, so that nobody is trusted for living under one.

    ``rules`` are public suffixes as their list writes them: ``co.uk``, ``*.ck``
    (every label under ck), ``!www.ck`` (but not this one). The longest rule
    holds, an exception before any other; a domain that none fits has its last
    label as suffix. Each suffix of a domain is looked up in sets, no table is searched."""
    rules = {r.strip().lower() for r in rules}
    plain = sorted(r for r in rules if r and r[0] not in "*!")
    wild, saved = sorted(r[2:] for r in rules if r.startswith("*.")), sorted(r[1:] for r in rules if r.startswith("!"))
    among = lambda x, names: x.isin(names) if names else F.lit(False)  # noqa: E731  (a hash set, beyond ten names)
    labels = F.filter(F.split(F.lower(F.coalesce(_c(col), F.lit(""))), "[.]"), lambda x: x != "")

    def base(parts: Column) -> Column:
        n = F.size(parts)
        last = lambda k: F.array_join(F.slice(parts, n - k + 1, k), ".")
        sizes = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        freed = F.array_max(F.transform(F.filter(sizes, lambda k: among(last(k), saved)), lambda k: k - 1))
        fits = F.filter(sizes, lambda k: among(last(k), plain) | ((k > 1) & among(last(k - 1), wild)))
        suffix = F.coalesce(freed, F.array_max(fits), F.lit(1))
        return F.when(n > suffix, last(suffix + 1)).otherwise(F.lit(""))

    return F.transform(F.array(labels), base)[0]
