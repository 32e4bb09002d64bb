"""Letters, sequences and k-letter words as column expressions.

Letters are a, c, g, t and, where asked for, n; input is taken in either case. n is a true fifth symbol here: words with it have
no code in base 4, and its complement is itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALPHABET = "acgt"
ALPHABET_N = "acgtn"
EPS = "E"  # how an empty letter is shown
MAX_K = 31  # so that a code in base 4 fits a signed 64-bit integer


def checked(seg: Column, alphabet: str = ALPHABET_N) -> Column:
    """Lower case; fails on any other symbol."""
    low = F.lower(seg)
    return F.when(low.rlike(f"[^{alphabet}]"), F.raise_error(F.concat(F.lit("invalid letter in "), seg)).cast("string")).otherwise(low)


def rev_comp(seg: Column) -> Column:
    return F.translate(F.reverse(seg), "acgt", "tgca")


def part(seg: Column, start: Column | int, length: Column | int) -> Column:
    """length letters from the 0-based place start."""
    return F.substring(seg, F.lit(start) + 1 if isinstance(start, int) else start + 1, F.lit(length) if isinstance(length, int) else length)


def common_prefix(a: Column, b: Column, block: int = 1024) -> Column:
    """Number of letters that a and b share from their starts: whole blocks are compared, then the letters of the first one that differs. Letters are single bytes, so the time is linear."""
    n = F.least(F.length(a), F.length(b))
    piece = lambda x, start, size: F.substring(x, start, F.lit(size))

    def found(p: Column) -> Column:
        same = F.transform(F.sequence(F.lit(0), F.greatest(p["n"] - 1, F.lit(0)).cast("int")), lambda i: piece(p["a"], i * block + 1, block) == piece(p["b"], i * block + 1, block))
        return F.array_position(same, False)

    def letters(q: Column) -> Column:
        differs = F.transform(F.sequence(F.lit(1), F.lit(block)), lambda i: F.coalesce(piece(q["a"], i, 1) == piece(q["b"], i, 1), F.lit(False)) & (F.length(piece(q["a"], i, 1)) > 0))
        first = F.array_position(differs, False)
        return F.when(first == 0, block).otherwise(first - 1)

    # Arrays of one element bind what they hold, so that it is made once and not for each block.
    pair = F.transform(F.array(F.struct(a.cast("binary").alias("a"), b.cast("binary").alias("b"), F.ceil(n / block).cast("int").alias("n"))), lambda p: F.struct(p.alias("p"), found(p).alias("k")))
    at = F.transform(pair, lambda x: F.when(x["k"] == 0, F.lit(None)).otherwise((x["k"] - 1) * block + letters(F.struct(piece(x["p"]["a"], ((x["k"] - 1) * block + 1).cast("int"), block).alias("a"), piece(x["p"]["b"], ((x["k"] - 1) * block + 1).cast("int"), block).alias("b")))))
    return F.when(n == 0, F.lit(0)).otherwise(F.least(n, F.coalesce(at[0], n))).cast("int")


def code(word: Column) -> Column:
    """The word as a number in base 4, first letter most significant."""
    return F.conv(F.translate(word, "acgt", "0123"), 4, 10).cast("long")


def level_start(k: Column) -> Column:
    """How many words are shorter than k letters: 0, 1, 5, 21, 85, ..."""
    return ((F.call_function("shiftleft", F.lit(1).cast("long"), (2 * k).cast("int")) - 1) / 3).cast("long")


def level_code(word: Column) -> Column:
    """Number of a word among all words ordered by length, then letters."""
    return level_start(F.length(word)) + F.coalesce(code(F.nullif(word, F.lit(""))), F.lit(0))


def push(word: Column, letter: Column, k: int) -> Column:
    """Append; a full word drops its oldest letter."""
    return F.right(F.concat(word, letter), F.lit(k))


def pop(word: Column) -> Column:
    """Without the newest letter."""
    return F.expr("''") if word is None else F.left(word, F.greatest(F.length(word) - 1, F.lit(0)))


def log2_floor(n: Column) -> Column:
    return F.length(F.bin(n)) - 1


def depth_for(locations: int) -> int:
    """The default word length for that many locations: half of floor(log2), rounded up."""
    return (max(1, locations).bit_length() - 1 + 1) // 2


def chosen_depth(locations: int, depth: int = 0, relative: int | None = None) -> int:
    """trie-depth if given, else the default plus trie-depth-rel; both at once and a depth beyond MAX_K fail."""
    if depth and relative:
        raise ValueError("depth and relative depth can't both be given")
    k = depth or depth_for(locations) + (relative or 0)
    if not 0 < k <= MAX_K:
        raise ValueError("K is too high" if k > MAX_K else "K must be positive")
    return k


def human(n: Column) -> Column:
    """1250 -> 1.25k, 15550 -> 15.5k: three digits, cut off, powers of 1000."""
    size = F.abs(n)
    out = size.cast("string")
    for unit, scale in (("k", 10**3), ("m", 10**6), ("g", 10**9), ("t", 10**12)):
        whole = F.floor(size / scale)
        places = F.when(whole < 10, 100).when(whole < 100, 10).otherwise(1)
        rest = F.floor(size / (F.lit(scale) / places)) - whole * places
        text = F.when(places == 1, whole.cast("string")).otherwise(F.concat(whole.cast("string"), F.lit("."), F.lpad(rest.cast("string"), F.when(places == 100, 2).otherwise(1), F.lit("0"))))
        out = F.when(size >= scale, F.concat(text, F.lit(unit))).otherwise(out)
    return F.when(n < 0, F.concat(F.lit("-"), out)).otherwise(out)
