"""Column functions over article, question and answer texts; built-in Spark expressions only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.sections import SECTION, SOURCE, TOPIC

#: Fixed values of the article format and of the prompts.
BOILERPLATE = "Nội dung bài viết"
#: Fixed name space of chunk ids.
CHUNK_NAMESPACE = "f47b6a3e-3f0e-4b8a-9c2e-2f8e6a1d7c50"
PASSAGE_CHARS, TITLE_CHARS, QUESTION_CHARS = 300, 40, 1000
_TERM = r"[\p{L}\p{N}_]++"
#: All characters that are white space by Unicode, as ``(?U)\s`` has them.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def _bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)``; the value is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), of), F.lit(0))


def stripped(text: Column) -> Column:
    """Without white space (any Unicode) at either end; only the ends are looked at."""
    return F.btrim(text, F.lit(_WHITE))


def _after(text: Column, pattern: str) -> Column:
    """What follows the first match of the pattern; the whole text without a match."""

    def rest(t: Column) -> Column:
        length = F.length(F.coalesce(F.regexp_substr(t, F.lit(pattern)), F.lit("")))
        return _bound(F.regexp_instr(t, F.lit(pattern)), lambda at: F.when(at > 0, F.substring(t, at + length, F.length(t))).otherwise(t))

    return _bound(text, rest)


_URL_LINE, _TITLE_LINE = r"(?mdU)^# SOURCE_URL:\s*(.*)", r"(?mdU)^#\s+(.*)$"


def unix_lines(text: Column) -> Column:
    """``text`` with one kind of line end, empty for null. Only a text with another kind is searched."""
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(F.coalesce(text, F.lit("")))


def after_url(unix: Column) -> Column:
    """What follows the line of the address."""
    return _after(unix, _URL_LINE)


def parse_lines(unix: Column, rest: Column) -> dict[str, Column]:
    """``parse_article`` of ``unix_lines`` and of what is ``after_url``."""

    def body(found: Column) -> Column:
        # ``found`` has no white space at its end, so what follows the lead is empty or has a character that tells.
        own = F.substring(found, len(BOILERPLATE) + 1, F.length(found))
        lead = F.startswith(found, F.lit(BOILERPLATE)) & F.rlike(F.left(own, F.lit(1)), F.lit(r"\A(?:\s|\z)"))
        return F.when(lead, own).otherwise(found)

    return {
        "url": stripped(F.regexp_extract(unix, _URL_LINE, 1)),
        "title": stripped(F.regexp_extract(rest, _TITLE_LINE, 1)),
        "body": stripped(_bound(stripped(_after(rest, _TITLE_LINE)), body)),
    }


def parse_article(text: Column) -> dict[str, Column]:
    """``url``, ``title`` and ``body`` of an article; absent parts are empty, never null."""
    unix = unix_lines(text)
    return parse_lines(unix, after_url(unix))


def context_header(title: Column, breadcrumb: Column, url: Column) -> Column:
    """``[topic | section | source]``; the section is left out where the breadcrumb is empty."""
    section = F.when(breadcrumb != "", F.concat(F.lit(f" | {SECTION}: "), breadcrumb)).otherwise(F.lit(""))
    return F.concat(F.lit(f"[{TOPIC}: "), title, section, F.lit(f" | {SOURCE}: "), url, F.lit("]"))


def with_context(title: Column, breadcrumb: Column, url: Column, content: Column) -> Column:
    return F.concat(context_header(title, breadcrumb, url), F.lit("\n\n"), content)


def chunk_id(article_type: Column, slug: Column, idx: Column) -> Column:
    """Name-based (version 5) UUID of ``type:slug:idx``."""
    name = F.concat_ws(":", article_type, slug, idx.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit(CHUNK_NAMESPACE.replace("-", ""))), F.encode(name, "UTF-8")))
    # The variant digit keeps its two low bits under a leading binary 10.
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def word_count(text: Column) -> Column:
    """Words between white space: the default token count."""
    return F.regexp_count(text, F.lit(r"(?U)\S++"))


#: As ``sections.whitespace_tokens``: with white space between them, texts' counts add up.
word_count.adds_up = True

#: Matches texts without a character that composition may change or join with the one before it: Latin, Vietnamese,
#: Cyrillic, dashes and quotes, CJK and whole Hangul syllables are composed. Possessive runs from the start on: one pass
#: without a trial at every place, which took twenty times as long.
_LATIN, _MORE = "[\x00-\u02FF]", "[\u0400-\u0482\u1E00-\u1EFF\u2010-\u2027\u4E00-\u9FFF\uAC00-\uD7A3]"
_COMPOSED = rf"\A{_LATIN}*+(?:{_MORE}++{_LATIN}*+)*+\z"
#: Matches composed texts whose letters are as old as any Unicode version in use and become one letter each in lower
#: case (U+0130 does not), so that ``words`` finds in them what ``terms`` does.
_OLD, _OTHER = "[\x00-\u012F\u0131-\u02FF]", "[\u0400-\u0482\u1E00-\u1EFF\u2010-\u2027\u4E00-\u9FA5\uAC00-\uD7A3]"
_PLAIN = rf"\A{_OLD}*+(?:{_OTHER}++{_OLD}*+)*+\z"


@F.pandas_udf(T.StringType())
def _nfc(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.str.normalize("NFC")


def terms(text: Column, normalise: bool = True) -> Column:
    """Lower-case runs of letters, digits and ``_`` after canonical composition.

    Composition is the one step without a built-in; only texts that it may change are sent
    to Python (null for the others). ``normalise=False`` leaves it out for texts that are
    known to be composed, and the plan then has no Python at all.
    """
    composed = F.coalesce(_nfc(F.when(~F.rlike(text, F.lit(_COMPOSED)), text)), text) if normalise else text
    return F.regexp_extract_all(F.lower(composed), F.lit(_TERM), F.lit(0))


def is_plain(text: Column) -> Column:
    """Whether ``words.plain_words`` may take the text."""
    return F.rlike(text, F.lit(_PLAIN))


def term_index(term: Column) -> Column:
    """Unsigned CRC-32 of the term's UTF-8 bytes."""
    return F.crc32(F.encode(term, "UTF-8"))


def query_vector(term_array: Column) -> Column:
    """Sorted distinct term indices, each of weight 1."""
    return F.transform(
        F.array_sort(F.array_distinct(F.transform(term_array, term_index))),
        lambda i: F.struct(i.alias("term_index"), F.lit(1.0).alias("weight")),
    )


def normalised(text: Column) -> Column:
    """For containment: without ``*``, white space collapsed and stripped."""
    return stripped(F.regexp_replace(F.regexp_replace(text, r"\*+", ""), r"(?U)\s+", " "))


def slug_from_url(url: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def chunk_body(text: Column) -> Column:
    """What follows the first blank line; the whole text if there is none."""
    at = F.instr(text, "\n\n")
    return F.when(at > 0, F.substring(text, at + 2, F.length(text))).otherwise(text)


def passage_of(text: Column) -> Column:
    """Without the leading ``[...]`` header, cut to 300 characters."""
    plain = stripped(F.regexp_replace(text, r"^\[[^\]]*\]\s*", ""))
    return F.when(F.length(plain) > PASSAGE_CHARS, F.concat(F.substring(plain, 1, PASSAGE_CHARS), F.lit("…"))).otherwise(plain)


def is_http_url(url: Column) -> Column:
    return url.rlike("^https?://")


def title_of(text: Column) -> Column:
    """A conversation's title: the first question, cut to 40 characters."""
    plain = stripped(text)
    return F.when(F.length(plain) > TITLE_CHARS, F.concat(F.substring(plain, 1, TITLE_CHARS), F.lit("…"))).otherwise(plain)


def split_citations(text: Column, source_count: Column) -> Column:
    """Ordered parts ``kind, value, n``; ``[n]`` is a citation only for ``1 <= n <= source_count``."""
    pieces = F.filter(F.split(text, r"(?=\[\d{1,9}\])|(?<=\[\d{1,9}\])"), lambda p: p != "")

    def part(piece: Column) -> Column:
        n = F.regexp_extract(piece, r"^\[(\d{1,9})\]$", 1)
        number = F.when(n != "", n.cast("int"))
        cited = F.coalesce(number.between(F.lit(1), source_count), F.lit(False))
        return F.struct(
            F.when(cited, "cite").otherwise("text").alias("kind"), piece.alias("value"), F.when(cited, number).alias("n")
        )

    return F.transform(pieces, part)


def shown_score(score: Column) -> Column:
    """Two decimals, null stays null."""
    return F.when(score.isNotNull(), F.format_string("%.2f", score.cast("double")))


def question_or_null(question: Column) -> Column:
    """The stripped question of 1 to 1000 characters, else null."""
    plain = stripped(F.coalesce(question, F.lit("")))
    return F.when(F.length(plain).between(1, QUESTION_CHARS), plain)
