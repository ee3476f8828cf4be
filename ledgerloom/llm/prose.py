"""Statistics of text in short blocks, counted on code points with array operations for a whole batch of texts at once."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from ledgerloom.llm import languages

#: The statistics of a block, in order.
STATS = (
    "symbol_ratio",
    "digit_ratio",
    "common_words",
    "mean_word_len",
    "ended_lines",
    "line_chars",
    "stop_rate",
    "figure_tokens",
    "separators",
    "marked_lines",
    "leaders",
    "vowelless_words",
    "single_letters",
    "long_tokens",
    "mixed_tokens",
    "signs_in_words",
    "case_switches",
    "markup",
)
#: Characters from which a block is closed at the next line end, and of a line from which it is broken at white space.
BLOCK_CHARS = 300
#: Characters whose arrays (about 90 bytes each) are built at a time; a longer text is read in slices.
CHUNK_CHARS = 1_500_000

#: Share of function words from which a text counts as of their language.
LEAST_COMMON = 0.1

_LETTER, _DIGIT, _SPACE, _UPPER, _VOWEL, _FOREIGN, _BREAK, _SIGN = (np.uint8(1 << k) for k in range(8))
_MULT = np.uint64(0x100000001B3)
_LONGEST = 14


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Class bits and lower case of every code point below 0x10000; hashes of the function words with their languages as bits."""
    kind, lower = np.zeros(0x10000, np.uint8), np.arange(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        s = chr(c)
        name = unicodedata.category(s) if not 0xD800 <= c < 0xE000 else "So"
        if name[0] in "LM":
            kind[c] = _LETTER | (_UPPER if name == "Lu" else 0) | (_FOREIGN if c > 0x24F and name[0] == "L" else 0)
            low = s.lower()
            lower[c] = ord(low) if len(low) == 1 else c
            base = unicodedata.normalize("NFD", low)[0]
            kind[c] |= _VOWEL if base in "aeiouyœæø" or c > 0x24F else 0
        elif name in ("Nd", "Nl", "No"):
            kind[c] = _DIGIT
        elif s.isspace() or name == "Cf" or c == 0:
            kind[c] = _SPACE | (_BREAK if s in "\n\r\v\f\x1c\x1d\x1e\x85  " else 0)
        else:
            kind[c] = _SIGN
    langs = list(languages.FUNCTION_WORDS)
    bits: dict[int, int] = {}
    for k, lang in enumerate(langs):
        for w in languages.FUNCTION_WORDS[lang].split():
            if w.isalpha() and 1 < len(w) <= _LONGEST:
                bits[_hash_of(w)] = bits.get(_hash_of(w), 0) | 1 << k
    keys = np.array(sorted(bits), np.uint64)
    return kind, lower, keys, np.array([bits[int(k)] for k in keys], np.int64), langs


def _hash_of(word: str) -> int:
    h = 7
    for c in word:
        h = (h * int(_MULT) + ord(c)) & 0xFFFFFFFFFFFFFFFF
    return h


def _is_in(code: np.ndarray, signs: str) -> np.ndarray:
    out = code == ord(signs[0])
    for s in signs[1:]:
        out |= code == ord(s)
    return out


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[False], x[:-1]])


def _after(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x[1:], [False]])


class Blocks:
    """The blocks of some texts: text number, characters, statistics; and per text the language found and its plain counts."""

    def __init__(self, text: np.ndarray, chars: np.ndarray, stats: np.ndarray, lang: list[str], plain: np.ndarray):
        self.text, self.chars, self.stats, self.lang, self.plain = text, chars, stats, lang, plain


#: Plain counts of a text, in order.
PLAIN = ("words", "letters", "tokens", "dense", "symbols", "lines", "ended", "common")


def blocks(texts: list[str]) -> Blocks:
    """Blocks of whole texts. Lines are put together until ``BLOCK_CHARS`` are reached; one of half of that stands alone, and a longer one is broken at white space."""
    kind, lower, keys, bits, langs = _tables()
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    code = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where(code < 0x10000, kind[np.minimum(code, 0xFFFF)], np.where((code >= 0x20000) & (code < 0x40000), _LETTER | _VOWEL | _FOREIGN, _SIGN))
    begin = np.cumsum(sizes) - sizes
    letter, digit, space, sign = c & _LETTER > 0, c & _DIGIT > 0, c & _SPACE > 0, c & _SIGN > 0
    upper, vowel, brk = c & _UPPER > 0, c & _VOWEL > 0, c & _BREAK > 0
    # Lines and blocks.
    line_end = np.flatnonzero(brk)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    starts = _pieces(line_start, line_end, space)
    owner = np.searchsorted(begin, starts, "right") - 1
    cell = (starts - begin[owner]) // BLOCK_CHARS
    own = np.diff(np.append(starts, len(code))) >= BLOCK_CHARS // 2
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1]) | own[1:] | own[:-1]])
    at = starts[new]
    text = owner[new]
    n = len(at)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask.view(np.uint8), at, dtype=np.int64)

    def of(position: np.ndarray) -> np.ndarray:
        return np.searchsorted(at, position, "right") - 1

    def count(position: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(of(position), weights, minlength=n)

    chars = np.diff(np.append(at, len(code))) - total(brk)
    letters, digits, signs = total(letter), total(digit), total(sign)
    dense = np.maximum(letters + digits + signs, 1)
    # Tokens: runs without white space; cell signs part tokens as well.
    comma = _is_in(code, ",;") & ~_after(space) & ~(_before(digit) & _after(digit))
    pipe = _is_in(code, "|\t") | comma
    inside = ~space & ~pipe
    t0, t1 = np.flatnonzero(inside & ~_before(inside)), np.flatnonzero(inside & ~_after(inside)) + 1
    up_to = np.concatenate([[0], np.cumsum(letter, dtype=np.int32)])
    plain = up_to[t1] == up_to[t0]
    of_token = of(t0)
    tokens = np.bincount(of_token, minlength=n)
    up_to_digit = np.concatenate([[0], np.cumsum(digit, dtype=np.int32)])
    figure = plain & ((up_to_digit[t1] > up_to_digit[t0]) | (t1 - t0 == 1))
    figures = np.bincount(of_token, figure, minlength=n)
    single = np.bincount(of_token, (t1 - t0 == 1) & ~plain, minlength=n)
    long = np.bincount(of_token, np.where(t1 - t0 >= 30, t1 - t0, 0), minlength=n)
    mixed = np.bincount(of_token, ~plain & (up_to_digit[t1] > up_to_digit[t0]), minlength=n)
    # Words: runs of letters.
    w0, w1 = np.flatnonzero(letter & ~_before(letter)), np.flatnonzero(letter & ~_after(letter)) + 1
    size = w1 - w0
    of_word = of(w0)
    words = np.bincount(of_word, minlength=n)
    up_to_vowel = np.concatenate([[0], np.cumsum(vowel, dtype=np.int32)])
    dull = np.bincount(of_word, (up_to_vowel[w1] == up_to_vowel[w0]) & (size >= 3), minlength=n)
    short = np.flatnonzero(size <= _LONGEST)
    h = np.full(len(short), 7, np.uint64)
    for k in range(_LONGEST):
        more = size[short] > k
        h[more] = h[more] * _MULT + lower[np.minimum(code[w0[short[more]] + k], 0xFFFF)]
    place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    known = keys[place] == h
    mask, home = bits[place[known]], of_word[short[known]]
    hits = np.stack([np.bincount(home, mask >> k & 1, minlength=n) for k in range(len(langs))])
    shared = np.zeros(len(mask))
    for k in range(len(langs)):
        shared += mask >> k & 1
    weight = np.stack([np.bincount(text[home], (mask >> k & 1) / np.maximum(shared, 1), minlength=len(texts)) for k in range(len(langs))])
    best = weight.argmax(0)
    foreign = np.bincount(text, total(c & _FOREIGN > 0), minlength=len(texts))
    all_letters = np.bincount(text, letters, minlength=len(texts))
    lang = ["script" if f > 0.5 * a else langs[b] if w >= 1.5 and w >= LEAST_COMMON * n_words else "other" for f, a, b, w, n_words in zip(foreign, all_letters, best, weight.max(0), np.bincount(text, words, minlength=len(texts)))]
    told = np.array([x in langs for x in lang])
    common = np.where(told[text], hits[best[text], np.arange(n)], hits.max(0))
    blank_before = _before(space)
    blank_before[0] = True
    # Lines with something on them.
    seen = np.concatenate([[0], np.cumsum(~space, dtype=np.int32)])
    filled = seen[line_end] > seen[line_start]
    l0, l1 = line_start[filled], line_end[filled]
    solid = np.flatnonzero(~space)
    last = solid[seen[l1] - 1]
    first = solid[seen[l0]]
    ended = _is_in(code[last], ".!?。！？؟।;:\"'”’»)") & ~((code[last] == 46) & (code[np.maximum(last - 1, 0)] == 46))
    lines = count(first)
    at_end = count(last)
    n_ended = count(last, ended)
    token = np.minimum(np.searchsorted(t0, first, "right") - 1, max(len(t0) - 1, 0))
    if len(t0):
        width, close = t1[token] - t0[token], code[t1[token] - 1]
        wordy = up_to[t1[token]] - up_to[t0[token]]
        # A mark stands before something: bullets, and numbers or letters closed by a point or bracket.
        mark = ((wordy == 0) & (width <= 2) & sign[first] | _is_in(close, ".)") & (width <= 6) & (wordy <= 4) & ((wordy == 0) | (width <= 3) | (code[first] == 40))) & (t1[token] < l1)
    else:
        mark = np.zeros(len(first), bool)
    marked = count(first, mark)
    stop = _is_in(code, ".!?。！？؟।") & _after(space | _is_in(code, "\"'”’»)")) & ~(_before(code == 46) | blank_before)
    stops = total(stop)
    gap = space & ~brk & ~_before(space) & _after(space & ~brk)
    cells = total(pipe | gap)
    repeated = sign & _before(sign) & (code == np.concatenate([[0], code[:-1]]))
    spaced = (code == 46) & _before(code == 32) & np.concatenate([[False, False], code[:-2] == 46])[: len(code)]
    leaders = total(repeated & _is_in(code, "._·…") | spaced)
    latin = letter & (c & _FOREIGN == 0)
    in_word = sign & _before(latin) & _after(latin) & ~_is_in(code, "'’-.,/&") | (code == 0xFFFD)
    switch = upper & _before(letter & ~upper)
    tags = total(_is_in(code, "<>{}=\\_#@^~`"))
    stats = np.stack(
        [
            signs / dense,
            digits / dense,
            common / np.maximum(words, 1),
            np.minimum(letters / np.maximum(words, 1), 30.0),
            np.where(at_end > 0, n_ended / np.maximum(at_end, 1), 1.0),
            np.log(np.minimum(chars / np.maximum(lines, 1), BLOCK_CHARS) + 1.0),
            stops / np.maximum(tokens, 1),
            figures / np.maximum(tokens, 1),
            cells / np.maximum(tokens, 1),
            marked / np.maximum(lines, 1),
            leaders / dense,
            dull / np.maximum(words, 1),
            single / np.maximum(tokens, 1),
            long / dense,
            mixed / np.maximum(tokens, 1),
            total(in_word) / dense,
            total(switch) / dense,
            tags / dense,
        ],
        1,
    )
    plain_counts = np.stack([np.bincount(text, x, minlength=len(texts)) for x in (words, letters, tokens, letters + digits + signs, signs, at_end, n_ended, common)], 1)
    some = letters + digits + signs > 0
    return Blocks(text[some], chars[some], stats[some], lang, plain_counts)


def blocks_of_long(text: str, size: int = CHUNK_CHARS) -> Blocks:
    """``blocks`` of one text of any length, read in slices of about ``size`` characters that end at a line end or white space, so memory is bounded.

    Common words are those of the language of each slice; the language of the text is that of most of its characters.
    """
    found, weight, lo = [], {}, 0
    while lo < len(text):
        hi = lo + size
        if hi < len(text):
            cut = max(text.rfind("\n", lo + size // 2, hi), -1)
            cut = cut if cut >= 0 else text.rfind(" ", lo + size // 2, hi)
            hi = cut + 1 if cut >= 0 else hi
        found.append(blocks([text[lo:hi]]))
        lang = found[-1].lang[0]
        weight[lang] = weight.get(lang, 0) + found[-1].chars.sum()
        lo = hi
    chars, stats = (np.concatenate(x) for x in ([f.chars for f in found], [f.stats for f in found]))
    return Blocks(np.zeros(len(chars), np.int64), chars, stats, [max(weight, key=weight.get)], sum(f.plain for f in found))


def _pieces(line_start: np.ndarray, line_end: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Where pieces begin: at every line, and in a long line after the next white space beyond each ``BLOCK_CHARS`` characters."""
    extra = np.maximum((line_end - line_start - 1) // BLOCK_CHARS, 0)
    if not extra.any():
        return line_start
    many = np.flatnonzero(extra)
    base = np.repeat(line_start[many], extra[many])
    k = np.arange(len(base)) - np.repeat(np.cumsum(extra[many]) - extra[many], extra[many]) + 1
    blank = np.flatnonzero(space)
    after = blank[np.minimum(np.searchsorted(blank, base + k * BLOCK_CHARS), len(blank) - 1)] + 1
    after = after[after < np.repeat(line_end[many], extra[many])]
    return np.unique(np.concatenate([line_start, after]))
