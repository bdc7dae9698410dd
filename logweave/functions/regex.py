"""ECMAScript regex terms rewritten for Java's regex engine.

The rewrite happens once per term on the driver. It keeps the meaning of the
constructs the two dialects share, spells out those that differ, and refuses
syntax that only Java knows.
"""

from __future__ import annotations

import re

_WORD_CHAR = "[A-Za-z0-9_]"
_BORDER = f"(?:(?<={_WORD_CHAR})(?!{_WORD_CHAR})|(?<!{_WORD_CHAR})(?={_WORD_CHAR}))"
_NO_BORDER = f"(?:(?<={_WORD_CHAR})(?={_WORD_CHAR})|(?<!{_WORD_CHAR})(?!{_WORD_CHAR}))"

# POSIX class names and their ASCII Java counterparts.
_POSIX = {
    "alnum": r"\p{Alnum}", "alpha": r"\p{Alpha}", "blank": r"\p{Blank}", "cntrl": r"\p{Cntrl}",
    "digit": r"\p{Digit}", "graph": r"\p{Graph}", "lower": r"\p{Lower}", "print": r"\p{Print}",
    "punct": r"\p{Punct}", "space": r"\s", "upper": r"\p{Upper}", "xdigit": r"\p{XDigit}",
    "d": r"\d", "w": r"\w", "s": r"\s",
}

# One alternative per construct; a character class is taken whole.
_PIECE = re.compile(
    r"""
      \\ (?: (?P<unicode>u[0-9A-Fa-f]{4}) | (?P<hex>x[0-9A-Fa-f]{2}) | (?P<ctrl>c[A-Za-z])
           | (?P<backref>[1-9][0-9]*) | (?P<nul>0) | (?P<esc>.) )
    | (?P<cls> \[ \^? (?: \[: [a-z]+ :\] | \\. | [^\]\\] )* \] )
    | (?P<group> \( \? (?: : | = | ! ) )
    | (?P<javagroup> \( \? )
    | (?P<quant> (?: [*+?] | \{ [0-9]+ (?: , [0-9]* )? \} ) \?? )
    | (?P<char> . )
    """,
    re.VERBOSE | re.DOTALL,
)

_CLASS_ITEM = re.compile(r"\[:([a-z]+):\]|\\(u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|.)|(.)", re.DOTALL)

_PLAIN_ESCAPES = set("dDwWsSfnrtv")


class InvalidRegex(ValueError):
    pass


def _code(char: str) -> str:
    """A literal character in a form that means the same inside and outside a class."""
    return f"\\x{{{ord(char):x}}}" if not char.isalnum() or not char.isascii() else char


def _escape(name: str) -> str:
    if name == "v":
        return "\\x{b}"
    if name in _PLAIN_ESCAPES:
        return "\\" + name
    if name.isalnum():
        raise InvalidRegex(f"unknown escape \\{name}")
    return _code(name)


def _char_class(text: str) -> str:
    negated = text.startswith("[^")
    inner = text[2:-1] if negated else text[1:-1]
    if not inner:
        return "[\\s\\S]" if negated else "(?!)"
    out = []
    for posix, escaped, char in _CLASS_ITEM.findall(inner):
        if posix:
            if posix not in _POSIX:
                raise InvalidRegex(f"unknown character class [:{posix}:]")
            out.append(_POSIX[posix])
        elif escaped:
            if len(escaped) > 1:
                out.append(_code(chr(int(escaped[1:], 16))))
            else:
                out.append("\\x{8}" if escaped == "b" else "\\x{0}" if escaped == "0" else _escape(escaped))
        else:
            out.append(char if char == "-" else _code(char))
    return f"[{'^' if negated else ''}{''.join(out)}]"


def to_java_regex(pattern: str) -> str:
    out = ["(?i)"]
    repeatable = False
    for piece in _PIECE.finditer(pattern):
        kind, text = piece.lastgroup, piece.group(piece.lastgroup)
        if kind == "quant":
            if not repeatable:
                raise InvalidRegex(f"nothing to repeat before {text}")
            out.append(text)
            repeatable = False
            continue
        repeatable = True
        if kind in ("unicode", "hex"):
            out.append(_code(chr(int(text[1:], 16))))
        elif kind == "ctrl":
            out.append(f"\\x{{{ord(text[1]) % 32:x}}}")
        elif kind == "backref":
            out.append(f"(?:\\{text})")
        elif kind == "nul":
            out.append("\\x{0}")
        elif kind == "esc":
            border = {"b": _BORDER, "B": _NO_BORDER}.get(text)
            out.append(border or _escape(text))
        elif kind == "cls":
            out.append(_char_class(text))
        elif kind == "group":
            out.append(text)
            repeatable = False
        elif kind == "javagroup":
            raise InvalidRegex(f"unsupported group at {piece.start()}")
        elif text == "^":
            out.append("\\A")
            repeatable = False
        elif text == "$":
            out.append("\\z")
            repeatable = False
        elif text == ".":
            out.append("[^\\n\\r]")
        elif text in "(|":
            out.append(text)
            repeatable = False
        elif text == ")":
            out.append(text)
        elif text in "[\\{":
            raise InvalidRegex(f"stray {text}")
        else:
            out.append(_code(text))
    return "".join(out)
