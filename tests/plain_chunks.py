"""Sections, blocks and chunks of one text after the other: what the plans of ``segments`` are tested against."""

from bisect import bisect_left
from collections.abc import Callable, Iterator


def split_blocks(text: str) -> list[str]:
    """Paragraphs, and fenced code as one block each, fences included."""
    groups: list[list[str]] = [[]]
    fenced = False
    for line in text.split("\n"):
        fence = line.strip().startswith("```")
        if fence and not fenced or not fenced and not line.strip():
            groups.append([])
        if fenced or line.strip():
            groups[-1].append(line)
        if fence:
            if fenced:
                groups.append([])
            fenced = not fenced
    return [b for b in ("\n".join(g).strip("\n") for g in groups) if b.strip()]


def _heading(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading: number signs and white space before a title."""
    title = line.lstrip("#")
    return (len(line) - len(title), title.strip()) if title != line and title[:1].isspace() else None


def split_sections(text: str) -> list[tuple[list[str], str]]:
    """(headings above, body) from each heading line to the next; what precedes the first has no headings."""
    lines = text.split("\n")
    heads = {i: h for i, x in enumerate(lines) if (h := _heading(x))}
    starts = [0, *heads] if 0 not in heads else list(heads)
    above: list[tuple[int, str]] = []
    out = []
    for start, end in zip(starts, [*starts[1:], len(lines)], strict=True):
        if start in heads:
            above = [h for h in above if h[0] < heads[start][0]] + [heads[start]]
        if body := "\n".join(lines[start:end]).strip():
            out.append(([title for _, title in above], body))
    return out


def count_tokens(text: str) -> int:
    return len(text.split())


def _pieces(segment: str, most: int, count: Callable[[str], int]) -> Iterator[str]:
    """A segment that is too long, in windows by index: each ends with the word with which it has ``most`` tokens, found by bisection."""
    words = segment.split()
    start = 0
    while start < len(words):
        if count is count_tokens:
            end = start + most
        else:
            end = start + 1 + bisect_left(range(start + 1, len(words)), most, key=lambda j: count(" ".join(words[start:j])))
        yield " ".join(words[start:end])
        start = end


def pack(segments: list[str], most: int, overlap: int, joiner: str, count: Callable[[str], int] = count_tokens) -> list[str]:
    """Segments packed greedily into chunks of at most ``most`` tokens.

    A new chunk opens with the last segments of the one before: always the very last, then more while they stay within
    ``overlap`` in all. It opens without them when the next segment would not fit behind them.
    """
    sized = [(s, count(s)) for x in segments for s in (_pieces(x, most, count) if count(x) > most else [x])]
    out: list[list[tuple[str, int]]] = []
    here: list[tuple[str, int]] = []
    for segment in sized:
        if here and sum(n for _, n in here) + segment[1] > most:
            out.append(here)
            tail: list[tuple[str, int]] = []
            for s in reversed(here if overlap > 0 else []):
                carried = sum(n for _, n in tail)
                if tail and (carried >= overlap or carried + s[1] > overlap):
                    break
                tail.append(s)
            here = tail[::-1]
            if sum(n for _, n in here) + segment[1] > most:
                here = []
        here = [*here, segment]
    return [joiner.join(s for s, _ in chunk) for chunk in [*out, here] if chunk]


def chunk_record(source_type: str, source_id: str, text: str, issue: int | None, comment: int | None, most: int = 500, overlap: int = 64, count: Callable[[str], int] = count_tokens) -> Iterator[tuple]:
    """Rows as ``corpus.CHUNK_SCHEMA`` has them: parents (sections of a document, or the one of an issue record) each followed by its children."""
    if source_type == "docs":
        sections = split_sections(text)
        name = f"doc:{source_id}"
    else:
        if issue is None or comment is None:
            raise ValueError(f"issue record without ids: {source_id}")
        sections = [([], text)]
        name = f"issue:{issue}:comment:{comment}"
    for p, (path, body) in enumerate(sections):
        parent = f"{name}:parent:{p}"
        yield source_id, "parent", parent, None, p, None, path, body
        stem = f"{parent}:child" if source_type == "docs" else f"{name}:child"
        for c, child in enumerate(pack(split_blocks(body), most, overlap, "\n\n", count)):
            yield source_id, "child", f"{stem}:{c}", parent, p, c, path, child
