"""Markdown sections and recursive splitting: the two helpers that need per-text state."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Header levels that open a section.
LEVELS = (2, 3, 4, 5)
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
#: Tokens kept free for the part number and for what token counters add.
SAFETY = 30
#: Fixed labels of the context header.
TOPIC, SECTION, SOURCE, PART = "Chủ đề", "Mục", "Nguồn", "phần"
_HEADING = re.compile(r"#{1,6}(\s|$)")
SECTION_TYPE = T.ArrayType(T.StructType().add("breadcrumb", T.StringType()).add("content", T.StringType()))


def _header(line: str) -> tuple[int, str] | None:
    marks = len(line) - len(line.lstrip("#"))
    if marks in LEVELS and line[marks : marks + 1] in ("", " "):
        return marks, line[marks:].strip()
    return None


def _paragraphs(body: str) -> Iterator[tuple[tuple[tuple[int, str], ...], str]]:
    """``(open headers, paragraph)``; header lines begin the paragraph that follows them."""
    path: list[tuple[int, str]] = []
    held: list[str] = []
    held_path: tuple[tuple[int, str], ...] = ()
    fence = ""
    for raw in body.split("\n"):
        line = raw.strip()
        if not line.isprintable():
            line = "".join(c for c in line if c.isprintable())
        if fence:
            if line.startswith(fence):
                fence = ""
        elif line.startswith(("```", "~~~")) and line.count(line[:3]) == 1:
            fence = line[:3]
        header = None if fence or line.startswith(("```", "~~~")) else _header(line)
        if (header or (not line and not fence)) and held:
            yield held_path, "\n".join(held)
            held = []
        if header:
            while path and path[-1][0] >= header[0]:
                path.pop()
            path.append(header)
        if line or fence:
            if not held:
                held_path = tuple(path)
            held.append(line)
    if held:
        yield held_path, "\n".join(held)


def split_sections(body: str) -> list[dict[str, str]]:
    """Sections by headers of level 2 to 5, without those that hold headers only.

    Paragraphs under the same headers are joined by two spaces and a newline. A header
    without text of its own joins the deeper section that follows it.
    """
    sections: list[tuple[tuple[tuple[int, str], ...], str]] = []
    for path, text in _paragraphs(body or ""):
        if sections:
            last_path, last = sections[-1]
            deeper = len(last_path) < len(path) and last.rsplit("\n", 1)[-1].startswith("#")
            if last_path == path or deeper:
                sections[-1] = (path, f"{last}  \n{text}")
                continue
        sections.append((path, text))
    return [
        {"breadcrumb": " > ".join(name for _, name in path), "content": text}
        for path, text in sections
        if any(line.strip() and not _HEADING.match(line) for line in text.split("\n"))
    ]


@F.pandas_udf(SECTION_TYPE)
def sections(bodies: pd.Series) -> pd.Series:
    return bodies.map(split_sections)


def recursive_split(text: str, budget: int, count: Callable[[str], int], separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``budget`` tokens where a separator allows it.

    The first separator that occurs is used and stays at the start of the piece after
    it; small pieces are joined while they fit, larger ones are split by the next one.
    """
    at = next(k for k, s in enumerate(separators) if s == "" or s in text)
    mark, rest = separators[at], separators[at + 1 :]
    if mark == "":
        pieces = list(text)
    else:
        first, *others = text.split(mark)
        pieces = [p for p in (first, *(mark + o for o in others)) if p]
    out: list[str] = []
    held: list[str] = []
    held_size = 0

    def close() -> None:
        nonlocal held, held_size
        if (joined := "".join(held).strip()):
            out.append(joined)
        held, held_size = [], 0

    for piece in pieces:
        size = count(piece)
        if size >= budget:
            close()
            if rest and (size > budget or mark):
                out += recursive_split(piece, budget, count, rest)
            elif piece.strip():
                out.append(piece.strip())
            continue
        if held and held_size + size > budget:
            close()
        held.append(piece)
        held_size += size
    close()
    return out


def guarded(content: str, header: str, count: Callable[[str], int], cap: int) -> list[str]:
    """Contents of the parts of one section above the cap; each fits below its header.

    Parts whose header and body still overflow are split again with less room, as long
    as that makes them smaller.
    """
    own = count(header)
    room = max(cap - own - SAFETY, 1)
    # The header stands before every part: where counts add up it is counted once, with the two words of the part's number.
    adds_up = getattr(count, "adds_up", False)
    parts: list[str] = []
    rest = recursive_split(content, room, count)[::-1]
    while rest:
        part = rest[-1]
        size = own + 2 + count(part) if adds_up else count(f"{header} ({PART} {len(parts) + 1}/{len(parts) + len(rest)})\n\n{part}")
        if size > cap:
            smaller = recursive_split(part, max(room - (size - cap) - 5, 1), count)
            if len(smaller) > 1:
                rest[-1:] = smaller[::-1]
                continue
        parts.append(rest.pop())
    return parts


def whitespace_tokens(text: str) -> int:
    return len(text.split())


#: The count of texts with white space between them is the sum of theirs.
whitespace_tokens.adds_up = True

#: ``first``: the place of the section's first part among all of the article; ``parts``: 0 where the section is whole.
PARTS_TYPE = "array<struct<section:int,breadcrumb:string,first:int,parts:int,contents:array<string>>>"


def article_parts(title: str, url: str, body: str, cap: int | None, count: Callable[[str], int]) -> list[tuple]:
    """``(section, breadcrumb, first, parts, contents)`` of an article's sections. What a section's parts share is there once."""
    out, first = [], 0
    for k, section in enumerate(split_sections(body)):
        crumb, content = section["breadcrumb"], section["content"]
        header = f"[{TOPIC}: {title}{f' | {SECTION}: {crumb}' if crumb else ''} | {SOURCE}: {url}]"
        if cap is None or count(f"{header}\n\n{content}") <= cap:
            out.append((k, crumb, first, 0, [content]))
        else:
            pieces = guarded(content, header, count, cap)
            out.append((k, crumb, first, len(pieces), pieces))
        first += len(out[-1][4])
    return out


def parts_column(title: Column, url: Column, body: Column, cap: int | None, counter: Callable[[str], int] = whitespace_tokens) -> Column:
    """The sections of an article with their parts, in order."""

    @F.pandas_udf(PARTS_TYPE)
    def split(titles: pd.Series, urls: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([article_parts(t, u, b, cap, counter) for t, u, b in zip(titles, urls, bodies, strict=True)])

    return split(title, url, body)
