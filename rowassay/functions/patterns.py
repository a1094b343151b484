"""Python patterns written in Java's dialect, from Python's own parse of them.

Every node of the parse tree is written out by what it matches in Python, so flags, escapes and
classes need no flags of Java's. What Java cannot say raises OnlyPython.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache
from re import _constants as C, _parser

# What Python's \s covers, and the digits and words of both dialects.
_SPACE = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_CLASSES = {
    "DIGIT": (r"\p{Nd}", "0-9"),
    "SPACE": (_SPACE, r"\x{9}-\x{d}\x{20}"),
    "WORD": (r"\p{L}\p{N}_", "0-9A-Za-z_"),
}
_ALPHABETS = re.ASCII | re.UNICODE
#: A range with more characters is not spelled out where case is ignored.
_SPELLED = 2000


class OnlyPython(ValueError):
    """A pattern that Java has no words for."""


@lru_cache(maxsize=1000)
def java_regex(pattern: str) -> str | None:
    """The pattern, matched at the start of the value as re.match does, in Java's dialect.

    None if it is not valid Python, in which case nothing can match it. Conditionals, references
    that ignore case or look behind, and wide ranges that ignore case raise OnlyPython. Letters and
    digits follow the Unicode version of the JVM.
    """
    try:
        compiled = re.compile(pattern)
        tree = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    return rf"\A(?:{_sequence(tree, compiled.flags, False)})"


def _sequence(items, flags: int, behind: bool) -> str:
    return "".join(_node(op, arg, flags, behind) for op, arg in items)


def _node(op, arg, flags: int, behind: bool) -> str:
    if op is C.LITERAL:
        return _set(_equal(arg, flags), False) if flags & re.IGNORECASE else _char(arg)
    if op is C.NOT_LITERAL:
        return _set(_equal(arg, flags), True)
    if op is C.ANY:
        return r"[\x{0}-\x{10ffff}]" if flags & re.DOTALL else r"[^\n]"
    if op is C.IN:
        return _members(arg, flags)
    if op is C.BRANCH:
        return "(?:" + "|".join(_sequence(a, flags, behind) for a in arg[1]) + ")"
    if op is C.SUBPATTERN:
        group, added, removed, inner = arg
        if added & _ALPHABETS:
            flags &= ~_ALPHABETS
        return ("(" if group is not None else "(?:") + _sequence(inner, (flags | added) & ~removed, behind) + ")"
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        times = f"{{{low},{'' if high is C.MAXREPEAT else high}}}"
        return f"(?:{_sequence(inner, flags, behind)}){times}" + {C.MAX_REPEAT: "", C.MIN_REPEAT: "?", C.POSSESSIVE_REPEAT: "+"}[op]
    if op is C.ATOMIC_GROUP:
        return f"(?>{_sequence(arg, flags, behind)})"
    if op in (C.ASSERT, C.ASSERT_NOT):
        side, inner = arg
        sign = "=" if op is C.ASSERT else "!"
        return f"(?{'<' if side < 0 else ''}{sign}{_sequence(inner, flags, behind or side < 0)})"
    if op is C.AT:
        return _place(arg, flags)
    if op is C.GROUPREF:
        if behind or flags & re.IGNORECASE:
            raise OnlyPython("a reference that looks behind or ignores case")
        return rf"(?:\{arg})"
    if op is C.FAILURE:
        return "(?!)"
    raise OnlyPython(str(op).lower())


def _place(at, flags: int) -> str:
    word = f"[{_category('WORD', flags)}]"
    edge = rf"(?<={word})(?!{word})|(?<!{word})(?={word})"
    inner = rf"(?<={word})(?={word})|(?<!{word})(?!{word})"
    if re.match(r"\B", "") is None:  # so it is in some versions of Python
        inner = rf"(?!\A\z)(?:{inner})"
    many = flags & re.MULTILINE
    return {
        C.AT_BEGINNING: r"(?:\A|(?<=\n))" if many else r"\A",
        C.AT_BEGINNING_STRING: r"\A",
        C.AT_END: r"(?=\n|\z)" if many else r"(?=\n?\z)",
        C.AT_END_STRING: r"\z",
        C.AT_BOUNDARY: f"(?:{edge})",
        C.AT_NON_BOUNDARY: f"(?:{inner})",
    }[at]


def _category(name: str, flags: int) -> str:
    return _CLASSES[name][1 if flags & re.ASCII else 0]


def _char(code: int) -> str:
    return rf"\x{{{code:x}}}"


def _set(codes, negated: bool) -> str:
    return f"[{'^' if negated else ''}{''.join(map(_char, sorted(codes)))}]"


def _members(items, flags: int) -> str:
    out, negated = [], False
    for op, arg in items:
        if op is C.NEGATE:
            negated = True
        elif op is C.LITERAL:
            out += map(_char, sorted(_equal(arg, flags)))
        elif op is C.RANGE:
            out.append(_range(*arg, flags))
        elif op is C.CATEGORY:
            name = str(arg).removeprefix("CATEGORY_")
            inside = _category(name.removeprefix("NOT_"), flags)
            out.append(f"[^{inside}]" if name.startswith("NOT_") else inside)
        else:
            raise OnlyPython(str(op).lower())
    # with a class inside, the whole union is negated by a class around it
    return f"[^[{''.join(out)}]]" if negated else f"[{''.join(out)}]"


def _range(low: int, high: int, flags: int) -> str:
    if not flags & re.IGNORECASE:
        return f"{_char(low)}-{_char(high)}"
    if high - low >= _SPELLED:
        raise OnlyPython("a wide range that ignores case")
    return "".join(map(_char, sorted({x for code in range(low, high + 1) for x in _equal(code, flags)})))


def _equal(code: int, flags: int) -> set[int]:
    """Characters that match a literal under the flags."""
    if not flags & re.IGNORECASE:
        return {code}
    if 0xD800 <= code < 0xE000:
        return {code}
    char = chr(code)
    near = {code}
    for _ in range(2):
        near |= {x for other in near for key in (chr(other).lower(), chr(other).lower()[0], chr(other).upper()) for x in _kin().get(key, ())}
    found = re.compile(re.escape(char), flags & (re.IGNORECASE | re.ASCII))
    return {x for x in near if found.fullmatch(chr(x))}


@lru_cache(maxsize=1)
def _kin() -> dict[str, set[int]]:
    """Code points by their lower and upper case."""
    found: defaultdict[str, set[int]] = defaultdict(set)
    for code in (*range(0xD800), *range(0xE000, 0x110000)):
        char = chr(code)
        low, up = char.lower(), char.upper()
        if low != char or up != char:
            found[low].add(code)
            found[up].add(code)
            found[low[0]].add(code)  # a dotted capital I becomes two characters
    return found
