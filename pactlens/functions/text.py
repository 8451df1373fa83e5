"""Column helpers for text: cleaning, matching forms and line handling.

Every helper takes and returns a ``Column`` built from JVM functions, so a chain of
them stays in one projection and needs no shuffle.  Java patterns carry the flags
``U`` (Unicode classes and case folding) and ``d`` (only ``\\n`` ends a line).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactlens import rules

# White space in the sense of a Unicode-aware strip: includes the separators 1C-1F.
WS = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
_OTHER_BREAKS = [*"\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"]


def java(pattern: str, ignore_case: bool = False) -> str:
    """The pattern with the flags under which Java matches as the rules intend."""
    return ("(?iUd)" if ignore_case else "(?Ud)") + pattern


# Characters beyond ASCII that match an ASCII letter when case is ignored.
_FOLDING_FROM, _FOLDING_TO = "\u0130\u0131\u017f\u212a", "iisk"
# What lower-casing leaves of them; the Kelvin sign becomes a k.
FOLDED = ["i\u0307", "\u0130", "\u0131", "\u017f"]


def folded(text: Column) -> Column:
    """The lower-case text in which anchors are looked for; best kept as a column."""
    odd = text.contains(_FOLDING_FROM[0])
    for c in _FOLDING_FROM[1:]:
        odd = odd | text.contains(c)
    return F.lower(F.when(odd, F.translate(text, _FOLDING_FROM, _FOLDING_TO)).otherwise(text))


def may_match(lower: Column, pattern: str) -> Column | None:
    """Whether the folded text holds an anchor of the pattern, None if it has no anchors."""
    hit = None
    for anchor in rules.ANCHORS.get(pattern, []):
        hit = lower.contains(anchor) if hit is None else hit | lower.contains(anchor)
    return hit


def matches(text: Column, pattern: str, lower: Column | None = None, may: Column | None = None) -> Column:
    """Case-insensitive search of a rule pattern.

    With the folded text at hand, the pattern is tried only where one of its anchors
    occurs, which is rare; ``may`` tells that instead where it is known already.
    """
    found = text.rlike(java(pattern, True))
    anchored = may_match(lower, pattern) if lower is not None else may
    return found if anchored is None else anchored & found


def first_match(text: Column, pattern: str) -> Column:
    """Text of the first case-insensitive match, null if there is none."""
    return F.regexp_substr(text, F.lit(java(pattern, True)))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.transform(F.array(value), use)[0]


# All white space of a Unicode-aware strip, for the trim functions.
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def _has_outer_space(text: Column) -> Column:
    """Whether a text begins or ends with white space; true for an empty one."""
    return F.lit(WS_CHARS).contains(F.left(text, F.lit(1))) | F.lit(WS_CHARS).contains(F.right(text, F.lit(1)))


def strip_ends(text: Column) -> Column:
    """``strip`` of a column most of whose texts have no outer space: those are not taken apart."""
    return F.when(_has_outer_space(text), strip(text)).otherwise(text)


def words(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(text, rf"(?U){WS}+"), lambda w: w != ""))


def lines(text: Column) -> Column:
    """Lines of a text; a trailing line break opens no further line."""
    # Split at one character, Java needs no pattern.
    split = F.when(_holds(text, _OTHER_BREAKS), F.split(text, LINE_BREAK)).otherwise(F.split(text, "\n"))
    return let(split, lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts))


def _every(spans: str) -> str:
    """All characters of a class such as ``a-cx``, written out."""
    out, i = [], 0
    while i < len(spans):
        if i + 2 < len(spans) and spans[i + 1] == "-":
            out += [chr(c) for c in range(ord(spans[i]), ord(spans[i + 2]) + 1)]
            i += 3
        else:
            out.append(spans[i])
            i += 1
    return "".join(out)


# One character-map pass does what five pattern passes would do.
_SPACES, _SINGLE, _DOUBLE = (_every(x) for x in (rules.EXOTIC_SPACES, rules.SINGLE_QUOTES, rules.DOUBLE_QUOTES))
_MAP_FROM = _SPACES + _SINGLE + _DOUBLE + _every(rules.ZERO_WIDTH)
_MAP_TO = " " * len(_SPACES) + "'" * len(_SINGLE) + '"' * len(_DOUBLE)


def _holds(text: Column, needles: list[str]) -> Column:
    found = text.contains(needles[0])
    for needle in needles[1:]:
        found = found | text.contains(needle)
    return found


def _where(text: Column, may, then) -> Column:
    """Run the costly ``then`` only on texts that ``may`` need it."""
    return let(text, lambda t: F.when(may(t), then(t)).otherwise(t))


def _where_present(text: Column, needles: list[str], then) -> Column:
    """Run the costly ``then`` only on texts that hold one of the needles."""
    return _where(text, lambda t: _holds(t, needles), then)


def normalize_encoding(text: Column) -> Column:
    """Line ends, invisible characters, spaces, quotes and long dashes."""
    text = _where_present(text, ["\r"], lambda t: F.regexp_replace(t, "\r\n|\r", "\n"))
    # Of ASCII only the grave accent is mapped.
    mapped = lambda t: (F.octet_length(t) != F.length(t)) | t.contains("`")
    text = _where(text, mapped, lambda t: F.translate(t, _MAP_FROM, _MAP_TO))
    return _where_present(
        text, list(rules.LONG_DASHES), lambda t: F.regexp_replace(t, rf"(?U){WS}*[{rules.LONG_DASHES}]{WS}*", " - ")
    )


def reconnect_hyphenated(text: Column) -> Column:
    """Join a word that a hyphen and a line break cut in two."""
    return _where_present(
        text, ["-\n"], lambda t: F.regexp_replace(t, "([a-zA-Z]{2,})-\n([a-z]{2,})", "$1$2")
    )


#: White space that ``normalize_encoding`` leaves as it is, and that which it does not.
_KEPT_SPACES = [c for c in WS_CHARS if c not in "\t\n\r " and c not in _SPACES]
_MAPPED_SPACES = [c for c in WS_CHARS if c == "\r" or c in _SPACES]


def normalize_whitespace(text: Column, encoded: bool = False) -> Column:
    """Single spaces, no trailing spaces, at most one blank line, no outer space.

    Patterns run on texts alone that can hold what they look for; ``encoded`` tells that C1 was done.
    """
    text = _where_present(text, ["\t"], lambda t: F.translate(t, "\t", " "))
    odd = ["  ", " \n", *_KEPT_SPACES, *([] if encoded else _MAPPED_SPACES)]
    # A group that took no part in the match is replaced by nothing.
    text = _where(
        text, lambda t: _holds(t, odd) | t.endswith(" "),
        lambda t: F.regexp_replace(t, r"(?U)[\s\x1c-\x1f&&[^\n]]+(?=\n|\z)|( ) +", "$1"))
    return _where(
        text, lambda t: t.contains("\n\n\n") | _has_outer_space(t),
        lambda t: F.regexp_replace(t, rf"(?U)\A{WS}+|{WS}+\z|(\n\n)\n+", "$1"))


def clean_text(text: Column) -> Column:
    """C4: the cleaned form of a text, empty for null or blank text."""
    cleaned = normalize_whitespace(reconnect_hyphenated(normalize_encoding(text)), encoded=True)
    return F.coalesce(cleaned, F.lit(""))


def matching_form(text: Column) -> Column:
    """The form in which a quotation is compared with its source."""
    hyphens = _every(rules.ALL_HYPHENS)
    text = F.translate(
        text,
        _SINGLE + _DOUBLE + hyphens + _every(rules.ZERO_WIDTH),
        "'" * len(_SINGLE) + '"' * len(_DOUBLE) + "-" * len(hyphens),
    )
    text = F.regexp_replace(text, rf"(?U){WS}+", " ")
    return F.coalesce(F.lower(F.trim(text)), F.lit(""))


def without_punctuation(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)[^\w\s]", "")


def is_blank(text: Column) -> Column:
    """Whether a text is null or has nothing but white space; one that begins otherwise is not read through."""
    text = F.coalesce(text, F.lit(""))
    return F.lit(WS_CHARS).contains(F.left(text, F.lit(1))) & (strip(text) == "")


def shown(value: Column, digits: int) -> Column:
    """A score as it is shown: half-even on the exact binary value, unlike ``round``."""
    return F.translate(F.format_number(value, digits), ",", "").cast("double")


def settle(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds costly columns so that later filters read them.

    A filter on a projected column is pushed below the projection with a copy of the
    expression for every mention.  Columns that a generator makes are not pushed.
    """
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    kept = [c for c in rows.columns if c not in columns]
    return rows.select(*kept, F.inline(F.array(made)))
