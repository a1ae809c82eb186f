"""Excerpts of sources: focus, trimming, wrapped positions and bounded reading."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import arrow_udf

_OPERATORS = frozenset("and or not near".split())
_WORD = re.compile(r"[^\W_]+")
_POSITION = re.compile(r"\s*([1-9]\d*)(?:\.([1-9]\d*))?\s*")


def query_words(query: str) -> list[str]:
    return [w for w in _WORD.findall(query) if w.casefold() not in _OPERATORS]


def focus(title: str | None, content: str | None, char_start: int, char_end: int, query: str) -> int:
    """Where the title, or else the content, first holds any word of the query; the article's start if
    neither does."""
    wanted = [w.casefold() for w in query_words(query)]
    content = content or ""
    for text, base in ((title or "", char_start), (content, char_end - len(content))):
        folded = text.casefold()
        found = [p for p in map(folded.find, wanted) if p >= 0]
        if found:
            return base + min(found)
    return char_start


def focus_col(text: Column, query: str) -> Column:
    """``focus`` within one text in built-in functions: an offset from 0, or null. ASCII case only."""
    places = [F.instr(F.lower(text), w.lower()) for w in query_words(query)]
    return F.array_min(F.filter(F.array(*places), lambda p: p > 0)) - 1


def trim_span(source: str, first: int, last: int, at: int, limit: int) -> tuple[str, int, int]:
    """Lines ``first`` to ``last`` of the source, or ``limit`` characters of them around ``at``, one third
    in front of it, with an ellipsis where something is cut; and the lines that it holds."""
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    first = max(1, min(first, len(starts)))
    last = max(first, min(last, len(starts)))
    begin = starts[first - 1]
    stop = starts[last] if last < len(starts) else len(source)
    if stop - begin <= limit:
        return source[begin:stop].rstrip("\r\n"), first, last
    at = max(begin, min(at, stop - 1))
    left = min(max(begin, at - limit // 3), stop - limit)
    right = left + limit
    shown = source[left:right]
    shown = ("…" + shown[1:]) if left > begin else shown
    shown = (shown[:-1] + "…") if right < stop else shown
    line = lambda x: source.count("\n", 0, x) + 1
    return shown, line(left), line(max(left, right - 1))


def wrap(line: str, width: int = 240) -> list[str]:
    """Sections of at most ``width`` characters that end behind their last blank, if they hold one."""
    rest, out = line.rstrip("\r\n"), []
    while len(rest) > width:
        cut = max(rest.rfind(" ", 0, width), rest.rfind("\t", 0, width))
        cut = cut + 1 if cut > 0 else width
        out.append(rest[:cut])
        rest = rest[cut:]
    return out + [rest] if rest or not out else out


def position(source: str, at: int, width: int) -> str:
    """``line.section`` of an offset."""
    at = max(0, min(at, len(source) - 1))
    begin = source.rfind("\n", 0, at) + 1
    inside, section = at - begin, 0
    for part in wrap(source[begin:].partition("\n")[0], width):
        section += 1
        if inside < len(part):
            break
        inside -= len(part)
    return f"{source.count(chr(10), 0, at) + 1}.{section}"


def read_lines(source: str, first: int, last: int, max_bytes: int) -> dict:
    """Lines ``first`` to ``last``, cut behind ``max_bytes`` bytes of UTF-8."""
    lines = source.splitlines(keepends=True)
    if not 1 <= first <= last:
        raise ValueError("lines count from 1, and the last isn't before the first")
    if first > len(lines):
        raise ValueError(f"the source has {len(lines)} lines")
    raw = "".join(lines[first - 1 : last]).encode()
    text = raw[:max_bytes].decode("utf-8", "ignore")
    shown, used = 0, 0
    for line in lines[first - 1 : last]:
        if used >= max_bytes:
            break
        shown, used = shown + 1, used + len(line.encode())
    if used > max_bytes and used - len(lines[first - 2 + shown].encode()) >= max_bytes:
        shown -= 1
    return {"text": text, "line_start": first, "line_end": first + max(0, shown - 1), "truncated": len(raw) > max_bytes, "has_before": first > 1, "has_after": first - 1 + shown < len(lines)}


def read_wrapped(source: str, where: str, before: int, after: int, width: int, max_bytes: int) -> dict:
    """The wrapped section at ``line.section`` with as many around it, nearest first, as fit."""
    match = _POSITION.fullmatch(where)
    if not match:
        raise ValueError("a position is a line and a section, such as 334.7")
    lines = source.splitlines(keepends=True)
    line, section = int(match[1]), int(match[2] or 1)
    if line > len(lines):
        raise ValueError(f"the source has {len(lines)} lines")
    if section > len(wrap(lines[line - 1], width)):
        raise ValueError(f"line {line} has no section {section}")

    def walk(step: int, wanted: int):
        here, parts = line, wrap(lines[line - 1], width)
        k = section + step
        while wanted:
            if 1 <= k <= len(parts):
                yield here, k, parts[k - 1]
                k, wanted = k + step, wanted - 1
                continue
            here += step
            if not 1 <= here <= len(lines):
                return
            parts = wrap(lines[here - 1], width)
            k = 1 if step > 0 else len(parts)

    show = lambda entry: f"{entry[0]}.{entry[1]}  {entry[2]}\n"
    anchor = (line, section, wrap(lines[line - 1], width)[section - 1])
    left, chosen, cut = max_bytes - len(show(anchor).encode()), [anchor], False
    if left < 0:
        raise ValueError("max_bytes is less than one section")
    sides = {-1: walk(-1, before), 1: walk(1, after)}
    while sides:
        for step in list(sides):
            entry = next(sides[step], None)
            if entry is None:
                del sides[step]
            elif (size := len(show(entry).encode())) <= left:
                chosen.append(entry)
                left -= size
            else:
                cut = True
                del sides[step]
    chosen.sort()
    (a, i, _), (b, j, _) = chosen[0], chosen[-1]
    return {"text": "".join(map(show, chosen)), "position_start": f"{a}.{i}", "position_end": f"{b}.{j}", "line_start": a, "line_end": b, "truncated": cut, "has_before": (a, i) > (1, 1), "has_after": b < len(lines) or j < len(wrap(lines[b - 1], width))}


trim_span_col = arrow_udf(trim_span, "struct<text:string,line_start:int,line_end:int>")
focus_udf = arrow_udf(focus, "int")
position_col = arrow_udf(position, "string")
