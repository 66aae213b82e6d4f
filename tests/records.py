"""An invented record for the tests, as bytes and as text."""

CHART = """\
001 MP-4471
003 EXAMPLE
005 20190304081527.0
008 190304s1971    dk            a  dan
034/1# $a a $b 25000 $b 50000
041/0# $a dan $a ger $h nor
052 $a 6920 $2 grid
052 $a 6924 $2 grid
110/2# $a Harbour Office $b Charts
245/10 $a Sound and Belt $b sea chart
246/3# $a Sund og Bælt
246/3# $a Sound chart $i short
246/3# $a Belt chart $i short $5 XB
300 $a 2 sheets $c 60 x 90 cm
490/0# $a Northern charts $v 12 $v 13 $x A $x B
700/1# $a Penn, Mira $4 ctg $9 n:1
700/1# $a Holt, Jens $4 ctg $9 n:2
700/1# $a Frost, Clara $4 egr $9 n:3
856/40 $u http://example.org/mp/4471
990 $x"""


def encoded(text: str, status: str = "n", kind: str = "z", encoding: str = "a") -> bytes:
    """The bytes of a record in the text form above."""
    entries, body = b"", b""
    for line in text.split("\n"):
        tag, rest = line[:3], line[3:]
        if tag.startswith("00"):
            raw = rest[1:].encode()
        else:
            marks, _, subs = rest.partition("$")
            marks = marks.strip().removeprefix("/").replace("#", " ") or "  "
            raw = marks.encode()
            for sub in ("$" + subs).split(" $") if subs else []:
                sub = sub.removeprefix("$")
                raw += b"\x1f" + sub[:1].encode() + sub[2:].encode()
        raw += b"\x1e"
        entries += f"{tag}{len(raw):04d}{len(body):05d}".encode()
        body += raw
    base = 24 + len(entries) + 1
    return f"{base + len(body) + 1:05d}{status}{kind}  {encoding}22{base:05d}   4500".encode() + entries + b"\x1e" + body + b"\x1d"
