"""Glob patterns as regular expressions for whole relative paths.

Supported: ``*``, ``**`` as a whole segment, ``?``, ``[...]``, ``[!...]``, ``{a,b}``, ``{1..3}``,
``{a..c}``, ``\\`` escapes, the extended patterns ``?(a|b)``, ``*(a|b)``, ``+(a|b)``, ``@(a|b)`` and
``!(a|b)``, and a leading ``!`` that negates the whole pattern.  Unless ``dot`` is set, a wildcard
at the start of a segment does not match a leading dot.  A last ``**`` matches whatever is
below, a trailing slash included.  Only the two negations need look-ahead (Java has it).
"""

from __future__ import annotations

import re
from functools import cache

#: Ranges of more numbers, one apart, become patterns of digits; others of more strings are refused.
LONG, RANGE = 100, 10_000


def _from(digits: str) -> list[str]:
    """Patterns of the numbers of that many digits from this one on."""
    if not digits.strip("0"):
        return ["[0-9]" * len(digits)]
    above = [f"[{int(digits[0]) + 1}-9]" + "[0-9]" * (len(digits) - 1)] if digits[0] < "9" else []
    return [digits[0] + p for p in _from(digits[1:])] + above


def _up_to(digits: str) -> list[str]:
    if not digits.strip("9"):
        return ["[0-9]" * len(digits)]
    below = [f"[0-{int(digits[0]) - 1}]" + "[0-9]" * (len(digits) - 1)] if digits[0] > "0" else []
    return below + [digits[0] + p for p in _up_to(digits[1:])]


def _between(low: str, high: str) -> list[str]:
    """Patterns of the numbers between two of equally many digits."""
    if low == high:
        return [low]
    if low[0] == high[0]:
        return [low[0] + p for p in _between(low[1:], high[1:])]
    inner = [f"[{int(low[0]) + 1}-{int(high[0]) - 1}]" + "[0-9]" * (len(low) - 1)] if int(high[0]) - int(low[0]) > 1 else []
    return [low[0] + p for p in _from(low[1:])] + inner + [high[0] + p for p in _up_to(high[1:])]


def _numbers(low: int, high: int, width: int) -> list[str]:
    """Patterns of all numbers from ``low`` to ``high``, padded to ``width``; a sign counts as a place."""
    out = []
    if low < 0:
        out += ["-" + p for p in _numbers(max(1, -high), -low, max(0, width - 1))]
        low = 0
    while low <= high:
        digits = max(width, len(str(low)))
        last = min(high, 10**digits - 1)
        out += _between(f"{low:0{digits}d}", f"{last:0{digits}d}")
        low = last + 1
    return out


def _range(body: str) -> list[str] | None:
    """The strings of ``1..3``, ``a..c`` or ``01..10..2`` (patterns, if there are many); None if it is no range."""
    m = re.fullmatch(r"(-?[0-9]+)\.\.(-?[0-9]+)(?:\.\.(-?[0-9]+))?|([A-Za-z])\.\.([A-Za-z])(?:\.\.(-?[0-9]+))?", body)
    if not m:
        return None
    number = m[1] is not None
    first, last = (int(m[1]), int(m[2])) if number else (ord(m[4]), ord(m[5]))
    step = abs(int(m[3] or m[6] or 1)) or 1
    padded = number and any(len(x.lstrip("-")) > 1 and x.lstrip("-")[0] == "0" for x in (m[1], m[2]))
    width = max(len(m[1]), len(m[2])) if padded else 0
    if number and step == 1 and abs(last - first) >= LONG:
        return _numbers(min(first, last), max(first, last), width)
    if abs(last - first) // step >= RANGE:
        raise ValueError(f"range is too long: {{{body}}}")
    values = range(first, last + (1 if last >= first else -1), step if last >= first else -step)
    return [f"{v:0{width}d}" if number else chr(v) for v in values]


def braces(pattern: str) -> list[str]:
    """Alternatives of the first outermost ``{a,b}`` or range, expanded recursively."""
    depth, start, cuts = 0, -1, []
    for i, c in enumerate(pattern):
        if c == "{":
            if depth == 0:
                start, cuts = i, [i]
            depth += 1
        elif c == "," and depth == 1:
            cuts.append(i)
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                values = _range(pattern[start + 1 : i])
                if len(cuts) > 1:
                    values = [pattern[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], i], strict=True)]
                if values is not None:
                    return [x for v in values for x in braces(pattern[:start] + v + pattern[i + 1 :])]
    return [pattern]


def _group(seg: str, at: int) -> tuple[list[str], int] | None:
    """Alternatives of the parenthesis that opens at ``at``, and where it closes; None if it doesn't."""
    depth, cuts = 0, [at]
    for i in range(at, len(seg)):
        if seg[i] == "(":
            depth += 1
        elif seg[i] == ")":
            depth -= 1
            if depth == 0:
                return [seg[a + 1 : b] for a, b in zip(cuts, [*cuts[1:], i], strict=True)], i
        elif seg[i] == "|" and depth == 1:
            cuts.append(i)
    return None


def segment(seg: str, dot: bool, start: bool = True) -> str:
    """Regular expression of one segment.  ``start``: whether the text begins here, where a leading dot counts."""
    out, i, n = [], 0, len(seg)
    while i < n:
        c, begin = seg[i], start and i == 0
        if c in "+@!?*" and seg[i + 1 : i + 2] == "(" and (found := _group(seg, i + 1)):
            options = "|".join(segment(o, dot, begin) for o in found[0])
            if c == "!":
                rest = segment(seg[found[1] + 1 :], dot, False)
                plain = "" if dot or not begin else r"(?!\.)"
                return "".join(out) + f"{plain}(?!(?:{options}){rest}(?:/|$))[^/]*{rest}"
            out.append(f"(?:{options})" + c.replace("@", ""))
            i = found[1] + 1
            continue
        if c == "*":
            j = i
            while j < n and seg[j] == "*":
                j += 1
            if begin and not dot:
                some = r"[^/.][^/]*"
                out.append(some if j == n or seg[j] in ".*?[" else f"(?:{some})?")
            else:
                out.append("[^/]+" if begin and j == n else "[^/]*")
            i = j
            continue
        if c == "?":
            out.append("[^/.]" if begin and not dot else "[^/]")
        elif c == "[" and (end := seg.find("]", i + 2)) > 0:
            body = seg[i + 1 : end]
            negated = body[0] in "!^"
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", body[negated:])
            out.append(f"[^/{body}]" if negated else f"[{body}]")
            i = end
        elif c == "\\" and i + 1 < n:
            i += 1
            out.append(re.escape(seg[i]))
        else:
            out.append(re.escape(c) if not c.isalnum() else c)
        i += 1
    return "".join(out)


def split(pattern: str) -> list[str]:
    """Segments; a slash within a parenthesis does not separate."""
    parts, depth = [""], 0
    for i, c in enumerate(pattern):
        opens = c == "(" and i and pattern[i - 1] in "+@!?*"
        depth += bool(opens or (depth and c == "(")) - bool(depth and c == ")")
        if c == "/" and not depth:
            parts.append("")
        else:
            parts[-1] += c
    return parts


def _one(pattern: str, dot: bool) -> str:
    any_segment = "[^/]+" if dot else r"[^/.][^/]*"
    parts = split(pattern)
    out = []
    for k, seg in enumerate(parts):
        last = k == len(parts) - 1
        if seg == "**":
            out.append(f"{any_segment}(?:/{any_segment})*/?" if last else f"(?:{any_segment}/)*")
        else:
            out.append(segment(seg, dot) + ("" if last else "/"))
    return "".join(out)


@cache
def glob_regex(pattern: str, dot: bool = False) -> str:
    """Anchored regular expression of a glob over whole relative paths."""
    bare = pattern.lstrip("!") if not pattern.startswith("!(") else pattern
    options = "|".join(_one(p, dot) for p in braces(bare))
    negated = (len(pattern) - len(bare)) % 2
    end = r"(?![\s\S])"  # the very end; ``$`` would allow a line break after it
    return f"^(?!(?:{options}){end})(?s:.*)" if negated else f"^(?:{options}){end}"


#: Around a path, so that literals at its start and end are told from others.
START, END = "\x02", "\x03"


def literals(pattern: str) -> list[list[str]]:
    """For each alternative of a glob, strings that every path it matches has (between START and END)."""
    bare = pattern.lstrip("!") if not pattern.startswith("!(") else pattern
    if (len(pattern) - len(bare)) % 2:
        return [[]]
    return [_literals(p) for p in braces(bare)]


def _literals(pattern: str) -> list[str]:
    runs, parts = [START], split(pattern)
    for k, seg in enumerate(parts):
        last, i = k == len(parts) - 1, 0
        if seg == "**":
            runs.append("")
            continue
        while i < len(seg):
            c = seg[i]
            if c in "+@!?*" and seg[i + 1 : i + 2] == "(" and (found := _group(seg, i + 1)):
                runs.append("")
                i = found[1] + 1
                continue
            if c in "*?":
                runs.append("")
            elif c == "[" and (end := seg.find("]", i + 2)) > 0:
                runs.append("")
                i = end
            else:
                i += c == "\\" and i + 1 < len(seg)
                runs[-1] += seg[i]
            i += 1
        runs[-1] += END if last else "/"
    return [r for r in runs if r.strip(START + END)]
