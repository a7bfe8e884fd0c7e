"""Texts as arrays: units, tokens and token classes of a batch of texts, without a loop over tokens.

A batch is one array of code points. Every step (character classes by a table, runs,
joined words, classes of whole words, names of words and units) is arithmetic on arrays.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np

#: Common function words by language.
FUNCTION_WORDS = {
    "en": "the of and a to in is it was that for on with as are be at by this from or which we not has have had but they their its were an been will there no all if more when who what so up out about into than them only some could would should may might can do does did before after because although while where how why you i he she your our my his her these those then most any every each other another between both until since unless whether nobody",
    "de": "der die das und ist in zu den von mit nicht ein eine einer eines einem einen auf für sich als auch es an werden wird wurde wurden aus er sie hat haben dass nach bei um noch wie über im am zum zur so nur oder aber vor mehr durch man sein war waren wir ich ihr wenn weil obwohl diese dieser dieses kein keine niemand jede jeder bis seit ohne zwischen was wer",
    "fr": "le la les de des du un une et est en que qui dans pour pas sur au aux avec ce cette ces il elle ils elles on nous vous je ne se sont par plus ou mais a ont été être sans comme si même entre parce lorsque quand leur leurs son sa ses y dont où personne chaque depuis",
    "es": "el la los las de del y que en un una es se no por con para su sus al lo como más o pero ha han fue fueron son está sin sobre entre ya si cuando porque aunque este esta estos estas desde hasta nadie cada muy también donde quien hay",
    "it": "il lo gli di che e è un una in per con non si da dei della delle nel nella sono ha hanno più ma come anche questo questa",
    "pt": "o os as do da dos das um uma em para com não por mais como foi são mas ao ele ela seu sua ou quando muito nos já também só pelo pela até isso entre",
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als bij maar uit door over naar hij zij wij ze werd wordt deze dit geen nog",
}
#: Common Chinese function characters, and punctuation that stands for itself.
FUNCTION_CHARACTERS = "的了是在和有不我这个也就都而及与着或一没为以对从到被把它那会能要很已但如果因可所上下中"
PUNCTUATION = ".,;:!?|•*-=<>#\"'()[]{}/&+~_`“”…。，、；：！？"
CLASSES = ["start", "new line", "tab", "spaces", "han", "lower", "lower, not ascii", "capitalised", "mixed case", "upper", "identifier", "dotted", "number", "large number", "date", "ascii symbol", "other symbol", "again"]

WORDS = sorted({w for words in FUNCTION_WORDS.values() for w in words.split()})
IDS = {c: i for i, c in enumerate([*CLASSES, *PUNCTUATION, *FUNCTION_CHARACTERS])}
WORD_IDS = {w: len(IDS) + i for i, w in enumerate(WORDS)}
SIZE = len(IDS) + len(WORD_IDS)

# characters: what a code point is, in bits; those of letters and digits are also what a word is made of
LOWER, UPPER, DIGIT, FOREIGN, SMALL, MARK, SPACE, CLOSED = (np.uint16(1 << i) for i in range(8))
LETTER = LOWER | UPPER | FOREIGN
#: Code points from here on count as those just below: rare ideographs and unassigned ones.
TOP = 0x33480
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TURN = np.uint64(pow(int(_BASE), -1, 1 << 64))


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point its bits, its class as a token of its own, and its lower case."""
    bits, alone, low = np.zeros(TOP, np.uint16), np.full(TOP, IDS["other symbol"], np.uint16), np.arange(TOP, dtype=np.uint32)
    for i in range(TOP):
        c = chr(i)
        kind = unicodedata.category(c)
        if c.isspace():
            bits[i] = SPACE
        elif kind[0] in "LM":
            if kind == "Lo" and unicodedata.name(c, "").startswith("CJK"):
                bits[i], alone[i] = CLOSED, IDS.get(c, IDS["han"])
                continue
            small, large = c.islower(), kind in ("Lu", "Lt")
            bits[i] = (LOWER if small else UPPER if large else FOREIGN) | (FOREIGN if i > 127 else np.uint16(0))
            if large and len(c.lower()) == 1:
                low[i] = ord(c.lower())
        elif kind[0] == "N":
            bits[i] = DIGIT
        elif c in IDS:
            alone[i] = IDS[c]
        elif i < 128:
            alone[i] = IDS["ascii symbol"]
    alone[10], alone[9] = IDS["new line"], IDS["tab"]
    return bits, alone, low


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _TURN))


def _names(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit name of values[start:end] for each range; equal ranges have equal names, trailing zeros don't matter."""
    up, down = _powers(1 << max(12, int(len(values)).bit_length()))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up[: len(values)])))
        h = (total[ends] - total[starts]) * down[np.minimum(starts, len(down) - 1)]
        return (h ^ (h >> np.uint64(31))) * _BASE


@cache
def _word_table() -> tuple[np.ndarray, np.ndarray, int]:
    """Open table of the function words' names: (names, ids, bits)."""
    _, _, low = _tables()
    text = "".join(WORDS)
    ends = np.cumsum([len(w) for w in WORDS])
    starts = ends - [len(w) for w in WORDS]
    names = _names(low[np.array([ord(c) for c in text])].astype(np.uint64) + np.uint64(1), starts, ends)
    bits = 12
    while len(np.unique(names >> np.uint64(64 - bits))) < len(names):
        bits += 1
    key, ids = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint16)
    slot = names >> np.uint64(64 - bits)
    key[slot], ids[slot] = names, [WORD_IDS[w] for w in WORDS]
    return key, ids, bits


@dataclass(frozen=True)
class Shapes:
    """Units and tokens of a batch of texts: of each unit its text and length, of each token its unit and class."""

    text: np.ndarray  # of each unit
    length: np.ndarray
    again: np.ndarray  # whether the unit has stood in its text at least `repeated` - 1 times before
    unit: np.ndarray  # of each token
    kind: np.ndarray

    def codes(self) -> np.ndarray:
        """Codes of the transitions into each token, from the class of the token before in its unit; a unit, and each token of a repeated one, begins with `start`."""
        before = np.concatenate((np.zeros(1, np.int64), self.kind[:-1].astype(np.int64)))
        before[np.flatnonzero(np.diff(self.unit, prepend=-1))] = IDS["start"]
        before[self.kind == IDS["again"]] = IDS["start"]
        return before * SIZE + self.kind


def _breaks(points: np.ndarray, bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where units start: at texts, after line ends, and where a sentence has ended."""
    own = np.zeros(len(points), bool)
    own[first] = True
    start = own.copy()
    stop = (points == 46) | (points == 33) | (points == 63)
    close = (points == 34) | (points == 0x201D) | (points == 41)
    ended = np.flatnonzero(stop)
    space = bits == SPACE
    for shift in (1, 2):  # a space right after the stop, or after a closing sign
        at = ended + shift
        at = at[at + 1 < len(points)]
        fine = space[at] & ~space[at + 1] & ~own[at]
        if shift == 2:
            fine &= close[at - 1] & ~own[at - 1]
        start[at[fine] + 1] = True
    for mark in (10, 0x3002, 0xFF01, 0xFF1F):
        start[1:] |= points[:-1] == mark
    return start


def shapes(texts: list[str], repeated: int = 3) -> Shapes:
    """The units and tokens of texts. Units are lines with their ends and sentences within lines; together they are the text, with its line ends made alike."""
    table, alone, low = _tables()
    texts = [t.replace("\r\n", "\n").replace("\r", "\n") for t in texts]
    sizes = np.array([len(t) for t in texts], np.int64)
    points = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), TOP - 1)
    n, none = len(points), np.zeros(0, np.int64)
    if not n:
        return Shapes(none, none, none.astype(bool), none, none)
    firsts = np.cumsum(sizes) - sizes
    bits = table[points]
    start = _breaks(points, bits, firsts[sizes > 0])
    units = np.flatnonzero(start)
    owner = np.searchsorted(firsts[sizes > 0], units, "right") - 1
    text = np.flatnonzero(sizes > 0)[owner]

    # runs of letters and digits; digits in front of letters are a number of their own
    body = (bits & (LETTER | DIGIT)) != 0
    before = np.concatenate((np.zeros(1, bool), body[:-1])) & ~start
    run = np.flatnonzero(body & ~before)
    digit = (bits & DIGIT) != 0
    turn = np.flatnonzero(body & before & ~digit)
    turn = turn[digit[turn - 1]]
    if len(turn):
        home = np.searchsorted(run, turn, "right") - 1
        lead = (np.diff(home, prepend=-1) != 0) & digit[run[home]]
        letters = np.flatnonzero((bits & LETTER) != 0)
        lead &= np.searchsorted(letters, run[home]) == np.searchsorted(letters, turn)
        run = np.sort(np.concatenate((run, turn[lead])))
    stops = np.flatnonzero(body & ~np.concatenate((body[1:] & ~start[1:], np.zeros(1, bool)))) + 1
    end = np.minimum(stops[np.searchsorted(stops, run, "right")], np.concatenate((run[1:], [n]))) if len(run) else none
    # runs that one sign joins: words by ' - _ . and numbers by . , : - /
    joint = np.zeros(len(run), bool)
    if len(run) > 1:
        near = np.flatnonzero((run[1:] == end[:-1] + 1) & ~start[run[1:]] & ~start[end[:-1]])
        sign, left, right = points[end[near]], digit[run[near]], digit[run[near + 1]]
        word = ~left & ((sign == 39) | (sign == 0x2019) | (sign == 95) | (sign == 46) | (sign == 45))
        number = left & right & ((sign == 46) | (sign == 44) | (sign == 58) | (sign == 45) | (sign == 47))
        joint[near[word | number] + 1] = True
    signs = run[joint] - 1
    words = run[~joint]
    last = end[np.concatenate((np.flatnonzero(~joint)[1:] - 1, [len(run) - 1]))] if len(run) else none

    # classes of words: what their characters are together
    flags = (bits & (LETTER | DIGIT)).astype(np.uint16)
    flags[signs] = np.where(points[signs] == 46, SMALL, np.where(points[signs] == 95, MARK, np.where(points[signs] == 39, np.uint16(0), SPACE)))
    kinds = np.zeros(len(words), np.uint16)
    if len(words):
        head, size = flags[words], last - words
        flags[words] = 0
        tail = np.bitwise_or.reduceat(flags, words)
        whole, has = head | tail, lambda x, b: (x & b) != 0
        names = _names(low[points].astype(np.uint64) + np.uint64(1), words, last)
        key, ids, wide = _word_table()
        slot = names >> np.uint64(64 - wide)
        known = key[slot] == names
        rest_small = has(tail, LOWER) & ~has(tail, UPPER)
        small = has(whole, LOWER) & ~has(whole, UPPER)
        odd = has(whole, FOREIGN)
        is_digit = has(head, DIGIT)
        dated = has(whole, SPACE)
        c = IDS
        kinds = np.select(
            [is_digit & (size < 4), is_digit & dated, is_digit & (size < 5) & ~has(whole, SMALL), is_digit, known, has(whole, MARK) | has(whole, DIGIT),
             has(whole, UPPER) & ~has(whole, LOWER) & (size > 1), has(whole, SMALL), odd & (small | has(head, FOREIGN)), odd & rest_small, odd,
             has(head, UPPER) & (rest_small | (size == 1)), has(head, UPPER), small],
            [c["number"], c["date"], c["number"], c["large number"], ids[slot].astype(np.int64), c["identifier"],
             c["upper"], c["dotted"], c["lower, not ascii"], c["capitalised"], c["mixed case"],
             c["capitalised"], c["mixed case"], c["lower"]], np.int64(c["mixed case"])).astype(np.uint16)

    # tokens of one character, runs of spaces, and line ends with the indentation after them
    space = bits == SPACE
    single = ~body & ~space
    single[signs] = False
    line, tab = points == 10, points == 9
    plain = space & ~line & ~tab
    lead = np.concatenate((np.zeros(1, bool), plain[:-1] & ~start[1:]))
    follow = np.concatenate((plain[1:] & ~start[1:], np.zeros(1, bool)))
    wide = plain & ~lead & follow
    if n > 1:
        wide[1:] &= ~(line[:-1] & ~start[1:])
    other = np.flatnonzero(single | line | tab | wide)
    other_kind = np.where(plain[other], np.uint16(IDS["spaces"]), alone[points[other]])
    place = np.concatenate((words, other))
    order = np.argsort(place, kind="stable")
    place, kind = place[order], np.concatenate((kinds, other_kind))[order]
    unit = np.searchsorted(units, place, "right") - 1

    # units that have stood in their text before, by the name of what they hold besides the spaces around
    shown = np.flatnonzero(~space)
    value = np.where(space, np.uint64(0), low[points].astype(np.uint64) + np.uint64(1))
    ends = np.concatenate((units[1:], [n]))
    at = np.searchsorted(shown, units)
    filled = at < np.searchsorted(shown, ends)
    begin = np.where(filled, shown[np.minimum(at, max(0, len(shown) - 1))], units) if len(shown) else units
    name = _names(value, begin, ends)
    order = np.lexsort((np.arange(len(units)), name, text))
    same = np.concatenate((np.zeros(1, bool), (name[order][1:] == name[order][:-1]) & (text[order][1:] == text[order][:-1])))
    nth = np.arange(len(units)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(units))))
    again = np.zeros(len(units), bool)
    again[order] = nth + 1 >= repeated
    again &= filled
    kind = np.where(again[unit], np.uint16(IDS["again"]), kind)
    return Shapes(text, ends - units, again, unit, kind)
