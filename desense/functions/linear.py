"""Patterns of the rule language for an engine that never backtracks.

Arrow's regular expressions search in time linear in the text, whatever the pattern, but
their classes are ASCII. ``to_linear`` says a pattern in their terms, with the classes of the
rule language (digits, words and white space of all scripts), or gives none where it holds
what that engine has no like of: then Java's engine, which backtracks, has to search.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc

from desense.functions.matching import MARK

#: What classes hold, as the body of a bracket.
_CLASSES = {
    "d": r"\p{Nd}",
    "w": r"\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\x{24B6}-\x{24E9}\x{1F130}-\x{1F149}\x{1F150}-\x{1F169}\x{1F170}-\x{1F189}",
    "s": r"\t-\r\x{85}\p{Z}",
}
_TOKEN = re.compile(
    r"""(?P<escape>\\[^A-Za-z0-9\s]|\\[tnrf]|\\[pP](?:[LMNPSZC]|\{(?:[LMNPSZC][a-z]?)\}))|(?P<set>\\[dws])|(?P<not>\\[DWS])
    |(?P<open>\((?:\?:)?(?![?*]))|(?P<close>\)|\|)|(?P<times>(?:[*+?]|\{(?P<least>\d+)(?:,(?P<most>\d*))?\})(?:\?(?![+?*{])|(?![+?*{])))
    |(?P<bracket>\[\^?(?:\\[^A-Za-z0-9\s]|\\[tnrf]|\\[dws]|[^\]\[\\&~-]|-)+\])|(?P<plain>[^\\()\[\]{}*+?|&~])|(?P<rest>[&~\]])""",
    re.X,
)
#: Without one of these a search takes time linear in the text in any engine.
_UNBOUNDED = re.compile(r"[*+$]|\{\d+,\}")
#: Counts beyond are refused by the engine.
MOST_TIMES = 1000


def to_linear(pattern: str) -> str | None:
    """The same pattern for ``marked``, or none."""
    out, at, counts = [], 0, 1
    while at < len(pattern):
        token = _TOKEN.match(pattern, at)
        if token is None:
            return None
        text, kind, at = token[0], token.lastgroup, token.end()
        if token["set"]:
            text = f"[{_CLASSES[text[1]]}]"
        elif token["not"]:
            text = f"[^{_CLASSES[text[1].lower()]}]"
        elif token["bracket"]:
            text = re.sub(r"\\([dws])", lambda m: _CLASSES[m[1]], text)
        elif kind in ("times", "least", "most"):
            counts *= max(int(token["most"] or 0), int(token["least"] or 0), 1)
        out.append(text)
    if counts > MOST_TIMES:
        return None
    made = "".join(out)
    try:
        pc.match_substring_regex(pa.array([""]), made)
    except pa.ArrowInvalid:
        return None
    return made


def needs_linear(pattern: str) -> bool:
    """Whether the pattern repeats without a bound, or ends at the end of the text."""
    return bool(_UNBOUNDED.search(pattern))


def marked(texts: pa.Array, pattern: str) -> list[list[str]]:
    """Of each text what stands before, in and after the matches of a linear pattern, by
    turns; a text that has the mark itself is marked with a character it lacks."""
    out: list[list[str]] = [[]] * len(texts)
    odd = pc.match_substring(texts, MARK).to_pylist()
    cut = pc.replace_substring_regex(texts, pattern, f"{MARK}\\0{MARK}").to_pylist()
    for i, text in enumerate(cut):
        if text is None:
            continue
        if odd[i]:
            own = set(texts[i].as_py())
            mark = next(chr(c) for c in range(0xE000, 0xF8FF) if chr(c) not in own)
            out[i] = pc.replace_substring_regex(texts.slice(i, 1), pattern, f"{mark}\\0{mark}")[0].as_py().split(mark)
        else:
            out[i] = text.split(MARK)
    return out
