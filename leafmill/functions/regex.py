"""Regular expressions of the matcher language as Java's.

The dialect searches anywhere and only tells whether there is a match, so groups capture nothing and greed does not matter.  It knows
Unicode classes and case folding by default, has ``.`` and ``$`` that know no line end but ``\\n``, set operations in classes, and neither
look-around nor back-references.  An expression is read by the dialect's grammar and written anew for Java; what the dialect does
not have, or Java can't express, is refused here and not when a job runs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

# Fixed values of the dialect: ASCII classes, long names of general categories, escapes of single characters.
POSIX = {
    "alnum": "0-9A-Za-z", "alpha": "A-Za-z", "ascii": r"\x00-\x7F", "blank": r"\t\x20", "cntrl": r"\x00-\x1F\x7F", "digit": "0-9", "graph": r"\x21-\x7E", "lower": "a-z",
    "print": r"\x20-\x7E", "punct": r"\x21-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E", "space": r"\t\n\x0B\f\r\x20", "upper": "A-Z", "word": "0-9A-Za-z_", "xdigit": "0-9A-Fa-f",
}
CATEGORIES = {
    "letter": "L", "casedletter": "LC", "uppercaseletter": "Lu", "lowercaseletter": "Ll", "titlecaseletter": "Lt", "modifierletter": "Lm", "otherletter": "Lo",
    "mark": "M", "nonspacingmark": "Mn", "spacingmark": "Mc", "enclosingmark": "Me", "number": "N", "decimalnumber": "Nd", "letternumber": "Nl", "othernumber": "No",
    "punctuation": "P", "connectorpunctuation": "Pc", "dashpunctuation": "Pd", "openpunctuation": "Ps", "closepunctuation": "Pe", "initialpunctuation": "Pi", "finalpunctuation": "Pf", "otherpunctuation": "Po",
    "symbol": "S", "mathsymbol": "Sm", "currencysymbol": "Sc", "modifiersymbol": "Sk", "othersymbol": "So", "separator": "Z", "spaceseparator": "Zs", "lineseparator": "Zl", "paragraphseparator": "Zp",
    "other": "C", "control": "Cc", "format": "Cf", "surrogate": "Cs", "privateuse": "Co", "unassigned": "Cn",
}
SINGLE = {"a": 7, "f": 12, "t": 9, "n": 10, "r": 13, "v": 11}
BOUNDARIES = {"start": r"(?<!\w)(?=\w)", "end": r"(?<=\w)(?!\w)", "start-half": r"(?<!\w)", "end-half": r"(?!\w)"}
_META = frozenset(r"\.+*?()|[]{}^$#&-~")
_DIGITS = frozenset("0123456789")


class Unsupported(ValueError):
    """The expression is not one of the dialect, or has no counterpart."""


@dataclass(frozen=True)
class Flags:
    lines: bool = False
    verbose: bool = False


def _char(c: str | int) -> str:
    """One character, for Java, within a class or outside."""
    code = c if isinstance(c, int) else ord(c)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        raise Unsupported("not a character")
    return f"\\x{{{code:X}}}" if code < 33 or 126 < code else ("\\" if chr(code) in _META else "") + chr(code)


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.at, self.names = text, 0, set()

    # -- characters

    def seen(self, mark: str) -> bool:
        return self.text.startswith(mark, self.at)

    def took(self, mark: str) -> bool:
        if self.seen(mark):
            self.at += len(mark)
            return True
        return False

    def next(self) -> str:
        if self.at >= len(self.text):
            raise Unsupported("the expression ends too early")
        self.at += 1
        return self.text[self.at - 1]

    def until(self, mark: str) -> str:
        end = self.text.find(mark, self.at)
        if end < 0:
            raise Unsupported(f"{mark} is missing")
        found, self.at = self.text[self.at : end], end + len(mark)
        return found

    def blank(self, flags: Flags) -> None:
        """Skips what verbose expressions may hold between their parts."""
        while flags.verbose and self.at < len(self.text):
            if self.text[self.at].isspace():
                self.at += 1
            elif self.text[self.at] == "#":
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                return

    # -- expressions

    def whole(self) -> str:
        out = self.alternatives(Flags())
        if self.at < len(self.text):
            raise Unsupported("a group is closed that is not open")
        return out

    def alternatives(self, flags: Flags) -> str:
        """Up to the end of the group.  Flags that are set within hold for what follows, over bars too."""
        parts = []
        while True:
            self.blank(flags)
            if self.at >= len(self.text) or self.seen(")"):
                return "".join(parts)
            if self.took("|"):
                parts.append("|")
                continue
            if self.took("(?"):
                made = self.group(flags)
                if isinstance(made, tuple):  # flags for the rest: Java's are part of the text, the others are ours
                    flags, mark = made
                    parts.append(mark)
                    continue
            elif self.took("("):
                made = self.closed(flags, "(?:")
            else:
                made = self.atom(flags)
            parts.append(self.repeated(made, flags))

    def closed(self, flags: Flags, begin: str) -> str:
        inner = self.alternatives(flags)
        if not self.took(")"):
            raise Unsupported("a group is not closed")
        return f"{begin}{inner})"

    def group(self, flags: Flags) -> str | tuple[Flags, str]:
        """What follows ``(?``."""
        if self.took("P<") or self.seen("<") and not self.text[self.at + 1 : self.at + 2] in ("=", "!") and self.took("<"):
            name = self.until(">")
            if not name or name[0] in _DIGITS or not all(c.isalnum() or c in "_.[]" for c in name) or name in self.names:
                raise Unsupported(f"not a name, or one that is taken: {name}")
            self.names.add(name)
            return self.closed(flags, "(?:")
        on, java, minus, count = True, {}, False, 0
        while (c := self.next()) not in ":)":
            if c == "-":
                if minus:
                    raise Unsupported("two signs among flags")
                on, minus, count = False, True, 0
            elif c in "is":
                java[c] = on
            elif c == "m":
                flags = replace(flags, lines=on)
            elif c == "x":
                flags = replace(flags, verbose=on)
            elif c == "u" and not on or c == "R" and on:
                raise Unsupported(f"not supported: flag {'' if on else '-'}{c}")
            elif c not in "UuR":
                raise Unsupported(f"not supported: (?{c}")
            count += c != "-"
        if minus and not count or c == ")" and not count:
            raise Unsupported("flags are missing")
        said = "".join(k for k, v in java.items() if v) + ("-" if not all(java.values()) else "") + "".join(k for k, v in java.items() if not v)
        if c == ":":
            return self.closed(flags, f"(?{said}:")
        return flags, f"(?{said})" if said else ""

    def repeated(self, made: str, flags: Flags) -> str:
        least, most = 1, 1
        counts = []
        while True:
            self.blank(flags)
            if self.took("*"):
                counts.append((0, None))
            elif self.took("+"):
                counts.append((1, None))
            elif self.took("?"):
                counts.append((0, 1))
            elif self.took("{"):
                low, comma, high = self.until("}").replace(" ", "").partition(",")
                if not all(set(x) <= _DIGITS for x in (low, high)) or not (low or high):
                    raise Unsupported("not a count")
                least = int(low or 0)
                most = least if not comma else int(high) if high else None
                if most is not None and most < least:
                    raise Unsupported("a count ends before it begins")
                counts.append((least, most))
            else:
                break
            self.took("?")  # lazy: the same answer
        if counts and not made:
            raise Unsupported("nothing to repeat")
        for least, most in _joined(counts):
            mark = {(0, None): "*", (1, None): "+", (0, 1): "?"}.get((least, most)) or (f"{{{least}}}" if least == most else f"{{{least},{'' if most is None else most}}}")
            made = f"(?:{made}){mark}"
        return made

    def atom(self, flags: Flags) -> str:
        c = self.next()
        if c in "*+?{":
            raise Unsupported("nothing to repeat")
        if c == ".":
            return "."
        if c == "^":
            return r"(?<![^\n])" if flags.lines else r"\A"
        if c == "$":
            return r"(?![^\n])" if flags.lines else r"\z"
        if c == "[":
            return self.char_class(flags)
        if c != "\\":
            return _char(c)
        c = self.next()
        if c == "b" and self.took("{"):
            name = self.until("}")
            if name not in BOUNDARIES:
                raise Unsupported(f"not a boundary: {name}")
            return BOUNDARIES[name]
        if c in "<>":
            return BOUNDARIES["start" if c == "<" else "end"]
        if c in "AzbB":
            return "\\" + c
        return self.escape(c)

    def escape(self, c: str) -> str:
        """A class or a character after a backslash."""
        if c in "dDsSwW":
            return "\\" + c
        if c in "pP":
            return self.prop(c == "P")
        code = self.code(c)
        return _char(code)

    def code(self, c: str) -> int:
        if c in SINGLE:
            return SINGLE[c]
        if c in "xuU":
            digits = self.until("}") if self.took("{") else "".join(self.next() for _ in range({"x": 2, "u": 4, "U": 8}[c]))
            try:
                return int(digits, 16)
            except ValueError:
                raise Unsupported(f"not a number: {digits}") from None
        if c.isascii() and c.isalnum():
            raise Unsupported(f"not supported: \\{c}")
        return ord(c)

    def prop(self, negated: bool) -> str:
        """A Unicode class, by one letter or a name; Java takes scripts, categories and properties by ``Is``."""
        name = self.until("}") if self.took("{") else self.next()
        if name.startswith("^"):
            negated, name = not negated, name[1:]
        for sign in ("!=", "=", ":"):
            if sign in name:
                key, _, name = name.partition(sign)
                negated ^= sign == "!="
                if key.strip().lower().replace("_", "") not in ("script", "sc", "scriptextensions", "scx", "generalcategory", "gc"):
                    raise Unsupported(f"not supported: property {key}")
                break
        plain = "".join(c for c in name.lower() if c not in " _-")
        if not plain.isalnum() or not plain.isascii():
            raise Unsupported(f"not a class: {name}")
        mark = "P" if negated else "p"
        if plain == "any":
            return r"[^\x{0}-\x{10FFFF}]" if negated else r"[\x{0}-\x{10FFFF}]"
        if plain == "ascii":
            return r"[^\x00-\x7F]" if negated else r"[\x00-\x7F]"
        if plain in CATEGORIES:
            return f"\\{mark}{{{CATEGORIES[plain]}}}"
        if len(plain) <= 2:
            return f"\\{mark}{{{plain[0].upper()}{plain[1:].lower() if plain != 'lc' else 'C'}}}"
        return f"\\{mark}{{Is{name.strip().replace(' ', '_').replace('-', '_')}}}"

    # -- classes

    def char_class(self, flags: Flags) -> str:
        """A class behind its bracket.  Operations have one precedence, from left to right; what stands side by side is joined first."""
        negated = self.took("^")
        held, operator, items, first = None, "", [], True
        while True:
            while flags.verbose and self.at < len(self.text) and self.text[self.at].isspace():
                self.at += 1
            if self.seen("]") and not first:
                self.at += 1
                whole = _combined(held, operator, items)
                return f"[^{whole}]" if negated else f"[{whole}]"
            if not first and (mark := next((m for m in ("&&", "--", "~~") if self.seen(m)), None)):
                self.at += 2
                held, operator, items = _combined(held, operator, items), mark, []
                continue
            items.append(self.item(flags))
            first = False

    def item(self, flags: Flags) -> str:
        if self.took("[:"):
            end = self.text.find(":]", self.at)
            name = self.text[self.at : end].removeprefix("^") if end > 0 else ""
            if name in POSIX:
                denied = self.text[self.at] == "^"
                self.at = end + 2
                return f"[^{POSIX[name]}]" if denied else f"[{POSIX[name]}]"
            self.at -= 2
        if self.took("["):
            return self.char_class(flags)
        low = self.single()
        if isinstance(low, str):
            return low
        if self.seen("-") and not self.seen("-]") and not self.seen("--"):
            self.at += 1
            high = self.single()
            if isinstance(high, str) or high < low:
                raise Unsupported("not a range")
            return f"{_char(low)}-{_char(high)}"
        return _char(low)

    def single(self) -> int | str:
        """A character of a class by its number, or a class within the class."""
        c = self.next()
        if c != "\\":
            return ord(c)
        c = self.next()
        if c in "dDsSwWpP":
            return self.escape(c)
        return ord(c) if c in "<>" else self.code(c)


def _combined(held: str | None, operator: str, items: list[str]) -> str:
    """The inside of a class that is ``held`` operator (union of items)."""
    own = "".join(items)
    if held is None:
        return own
    if not own:
        raise Unsupported("an operation of classes lacks a side")
    if operator == "&&":
        return f"[{held}]&&[{own}]"
    if operator == "--":
        return f"[{held}]&&[^{own}]"
    return f"[[{held}]&&[^{own}]][[{own}]&&[^{held}]]"


def _joined(counts: list[tuple[int, int | None]]) -> list[tuple[int, int | None]]:
    """Counts of counts; those without numbers come to one: x+? is x*, x++ is x+."""
    out: list[tuple[int, int | None]] = []
    plain = ((0, None), (1, None), (0, 1))
    for own in counts:
        if out and own in plain and out[-1] in plain:
            last = out.pop()
            own = own if own == last else (0, None)
        out.append(own)
    return out


def translated(pattern: str, ignore_case: bool = False) -> str:
    """The Java expression for a pattern; ValueError for what is no pattern of the dialect or can't be expressed."""
    out = "(?Ud)" + ("(?i)" if ignore_case else "") + _Reader(pattern).whole()
    _compiled(out)
    return out


def _compiled(expression: str) -> None:
    """Lets Java look at an expression, where a session is there to ask."""
    from pyspark.sql import SparkSession

    session = SparkSession.getActiveSession()
    if session is None or not hasattr(session, "_jvm"):
        return
    try:
        session._jvm.java.util.regex.Pattern.compile(expression)
    except Exception as error:
        raise Unsupported(f"not supported: {str(getattr(error, 'java_exception', error)).splitlines()[0]}") from None
