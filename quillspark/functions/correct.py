"""The correction stages as plain functions of a string, for Arrow batches.

The rules are regular expressions with lookaround and Unicode classes. As nested column expressions they cost a pass of the regex engine each,
whatever the text holds; here all stages run in one pass over a batch, and a plain search for characters without which a rule
can't match decides whether it runs at all. Most rules fire in few texts, so most texts cost the searches only.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

from quillspark.functions import rules as R

MODES = ("full", "greek", "general")
_greek = re.compile(R.GREEK).search
_in_greek = re.compile(rf"[{''.join(a for a, _ in R.IN_GREEK)}](?<={R.GREEK}.)(?={R.GREEK})").sub
_look_alike = dict(R.IN_GREEK)
_capitals = str.maketrans(*R.EPIGRAPHIC)
_angled = re.compile("<([^>]+)>").sub
RUN = rf"{R.GREEK}+(?:[\[\](){{}}⟨⟩]{R.GREEK}+)*"
_segments = re.compile(f"({RUN})").split
_brackets = [(a, re.compile(re.escape(a) + r"\s+").sub, z, re.compile(r"\s+" + re.escape(z)).sub) for a, z in R.OPENING_CLOSING]

#: For the general rules: one of these strings is in every text that the rule changes ('' where there is none).
SIGNS = {
    "G01": [""], "G02": ["-\n"], "G03": ["- \n"], "G04": ["  "], "G05": [" ,", " .", " !", " ?", " :", " ;"], "G06": ["\n\n\n"], "G07": ["1"], "G08": ["0"], "G09": ["ij"], "G10": ["rj"], "G11": ["cp"],
    "G12": ["<p"], "G13": ["©"], "G14": [";"], "G15": ["̓", "̔", "'"], "G16": ["p p."], "G18": ["op"], "G19": ["\t"], "G20": ["---", "--=", "--*", "-=", "-*", "=-", "==", "=*", "*-", "*=", "**"],
    "G21": ["$$"], "G22": ["$"], "G23": ["«"], "G24": ["»"], "G25": ["/9:/"], "G26": ["[9:]"], "G27": ['/"'],
}


def folded(text: str) -> str:
    """Letters without case, so that whatever a rule of either case matches has the same letters here."""
    return text if text.isascii() and text.islower() else text.upper().lower().replace("ς", "σ").replace("̇", "")


def beginning(pattern: str) -> str:
    """Characters with which every match of a pattern begins (there are no alternatives at a rule's top level)."""
    out, k = "", 0
    while k < len(pattern):
        if pattern[k : k + 2] == r"\b":
            k += 2
            continue
        if pattern[k] == "\\":
            if pattern[k + 1] == "u":
                c, step = chr(int(pattern[k + 2 : k + 6], 16)), 6
            elif pattern[k + 1].isalnum():
                break
            else:
                c, step = pattern[k + 1], 2
        elif pattern[k] in "[(.|^$":
            break
        else:
            c, step = pattern[k], 1
        if pattern[k + step : k + step + 1] in ("?", "*", "{"):
            break
        out, k = out + c, k + step
    return out


def _literal_first(pattern: str) -> str:
    """A look behind before a single character, moved behind it: the engine can then search for the character."""
    m = re.fullmatch(r"(\(\?<=)(\[[^\]]*\])\)([^\[\\(])(\(\?=.*\))", pattern)
    return f"{m[3]}{m[1]}{m[2]}{m[3]}){m[4]}" if m else pattern


@lru_cache(None)
def _compiled(pattern: str, flags: str) -> Callable:
    return re.compile(_literal_first(pattern), (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0)).sub


def apply_rules(text: str, rules) -> str:
    """Rules one after the other, each only where its characters are."""
    low = None
    for name, pattern, flags, replacement in rules:
        signs = SIGNS.get(name)
        if signs:
            if not any(s in text for s in signs):
                continue
        elif sign := _sign(pattern, flags):
            if "i" in flags:
                low = folded(text) if low is None else low
                if sign not in low:
                    continue
            elif sign not in text:
                continue
        after = _compiled(pattern, flags)(replacement, text)
        if after != text:
            text, low = after, None
    return text


@lru_cache(None)
def _sign(pattern: str, flags: str) -> str:
    return folded(beginning(pattern)) if "i" in flags else beginning(pattern)


def normalize_unicode(text: str) -> str:
    return text if text.isascii() else unicodedata.normalize("NFC", text)


def replace_chars(text: str) -> str:
    for a, b in R.CHARS:
        text = text.replace(a, b)
    return text


def clean_brackets(text: str) -> str:
    """No white space after an opening or before a closing editorial bracket."""
    for a, after, z, before in _brackets:
        if a in text:
            text = after(a, text)
        if z in text:
            text = before(z, text)
    return text


def latin_in_greek(text: str) -> str:
    """A Latin small letter between two Greek ones becomes its look-alike."""
    return _in_greek(lambda m: _look_alike[m[0]], text) if _greek(text) else text


def general_rules(text: str) -> str:
    return apply_rules(text, R.GENERAL)


def corpus_rules(text: str) -> str:
    return apply_rules(text, R.CORPUS)


def epigraphic(text: str) -> str:
    """Latin capitals within <...> become Greek."""
    return _angled(lambda m: f"<{m[1].translate(_capitals)}>", text) if "<" in text else text


@lru_cache(1)
def _words() -> list[tuple[str, Callable, str]]:
    return [(wrong, re.compile(rf"\b{wrong}\b" + (r"(?!\.)" if right == wrong + "." else "")).sub, right) for wrong, right in R.WORDS]


def word_rules(text: str) -> str:
    for wrong, sub, right in _words():
        if wrong in text:
            text = sub(right, text)
    return text


def final_sigma(run: str) -> str:
    """The rules for a run of Greek that can fire within one: final sigma and (ρ."""
    return apply_rules(run, R.GREEK_RUN_RULES[:2])


def greek_block(text: str) -> str:
    """All rules for Greek blocks, and the joining of fragments: for Greek blocks that hold more than a run."""
    return join_greek_fragments(apply_rules(text, R.GREEK_RUN_RULES))


def segment_rules(text: str, greek: bool = True) -> str:
    """Runs of Greek by their rules (if greek), what lies between them by the word rules."""
    if not _greek(text):
        return word_rules(text)
    parts = _segments(text)  # in turns: between, run, between, ...
    parts[::2] = map(word_rules, parts[::2])
    if greek:
        parts[1::2] = map(final_sigma, parts[1::2])
    return "".join(parts)


def fix_text(text: str, mode: str = "full", corpus: bool = True) -> str:
    text = general_rules(latin_in_greek(clean_brackets(replace_chars(normalize_unicode(text)))))
    if corpus:
        text = corpus_rules(text)
    return segment_rules(epigraphic(text), greek=mode != "general").strip()


_number = re.compile(r"\s*\d+(?:[.,]\d+)?\s*").fullmatch


def fix_cell(cell: str | None) -> str:
    """A table cell: empty for null, a number as it is (the rule for page numbers would empty it), else corrected."""
    return "" if not cell else cell.strip() if _number(cell) else fix_text(cell)


_pair = re.compile(f"({R.GREEK}+) ({R.GREEK}+)").sub


def _joined(m) -> str:
    a, b = m[1], m[2]
    return m[0] if a in R.STOPWORDS or b in R.STOPWORDS or min(len(a), len(b)) >= 4 else a + b


def join_greek_fragments(text: str) -> str:
    """Join Greek fragments over one space, unless one is a particle or both have four letters or more; five passes at most."""
    for _ in range(5):
        before, text = text, _pair(_joined, text)
        if text == before:
            break
    return text
