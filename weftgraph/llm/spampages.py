"""Keyword-stuffed and link-list pages: a hidden Markov model over the lines of a page.

A page is cut into lines, and lines into sentences. Each piece shows seven coarse features, none of which depends on a
language: the density of addresses, that of separators and prices, whether it ends as a sentence does, its length, how
much of it are words that it repeats itself, how much are words that the page repeats, and how its words divide between
prose and lists. The hidden states are prose, link list, tag list and menu; prose has two, its sentences and its headings,
which are short lines that don't follow one another for long. Emissions, transitions and first states start
from the values below and are re-estimated by soft expectation-maximisation (forward-backward) over all pages, whose
expected counts are summed by Spark; between the rounds the words' odds are learned from the labels that the model gives to their pieces, so function
words and sales words of any language in the corpus are found, not listed. Viterbi labels every piece of every page; a page
is flagged if more than half of its words lie in pieces that are not prose.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATES = ("prose", "link_list", "tag_list", "menu")
#: The label of each hidden state: the last is the headings of prose.
LABEL_OF = np.array([0, 1, 2, 3, 0])
ROUNDS, PRIOR_WEIGHT = 3, 100.0
FLAG_SHARE = 0.5
#: A word has odds if it occurs so often, on so many pages, and so often for each page of the table, on such a share of them: a
#: page has few different words, so the words with odds are bounded whatever the number of pages.
WORD_COUNT, WORD_PAGES, WORD_MOST = 10, 5, 3.0
WORD_RATE, WORD_SHARE = 1 / 200, 1 / 400
#: Expected counts are summed as whole numbers of this part, so that their order is of no account.
UNIT = 1_000_000
#: Shorter words count as no repetition.
LONG_WORD = 4
#: The bytes that part words.
IS_BLANK = np.isin(np.arange(256), list(b"\t\n\f\r "))

ADDRESS = r"(?:https?|hxxps?|ftp)[:\[]|www\.|\[ ?(?:dot|punkt|point|punto) ?\]|\(dot\)|[a-z0-9-]\.(?:com|net|org|info|biz|shop|example|invalid|test|html?)\b"
SEPARATOR = r"[|»·•;#/>~_]|\(\d+\)|\b\d+[.,]\d\d\b|\b[a-z]{1,4}-\d+\b"
SENTENCE_END = r"[.!?…][\"'”’»)\]]*\s*$"
BOUNDS = ((0.0, 0.2), (0.0, 0.15), (), (3, 8, 45), (0.0, 0.25, 0.5), (0.25, 0.5, 0.8), (-0.8, -0.2, 0.2, 0.8))
WIDTHS = (3, 3, 2, 4, 4, 4, 5)

# Starting emissions, one row per state: (address density, separators, sentence end, length, repetition in the piece, repetition
# on the page, word odds). The odds start without a preference.
EVEN = (0.2, 0.2, 0.2, 0.2, 0.2)
START = (
    ((0.93, 0.06, 0.01), (0.85, 0.14, 0.01), (0.12, 0.88), (0.04, 0.10, 0.82, 0.04), (0.85, 0.12, 0.02, 0.01), (0.50, 0.30, 0.15, 0.05), EVEN),
    ((0.05, 0.15, 0.80), (0.20, 0.20, 0.60), (0.97, 0.03), (0.35, 0.45, 0.15, 0.05), (0.60, 0.15, 0.15, 0.10), (0.20, 0.25, 0.30, 0.25), EVEN),
    ((0.97, 0.02, 0.01), (0.45, 0.10, 0.45), (0.75, 0.25), (0.30, 0.30, 0.20, 0.20), (0.25, 0.15, 0.20, 0.40), (0.05, 0.10, 0.25, 0.60), EVEN),
    ((0.90, 0.08, 0.02), (0.10, 0.15, 0.75), (0.95, 0.05), (0.15, 0.35, 0.20, 0.30), (0.50, 0.20, 0.15, 0.15), (0.25, 0.25, 0.25, 0.25), EVEN),
    ((0.98, 0.01, 0.01), (0.85, 0.10, 0.05), (0.95, 0.05), (0.55, 0.43, 0.01, 0.01), (0.97, 0.01, 0.01, 0.01), (0.60, 0.15, 0.10, 0.15), EVEN),
)
FIRST = (0.80, 0.03, 0.04, 0.02, 0.11)
# Starting transitions: states last, but headings lead to prose; those of headings stay as they are here, so that a list of
# short lines can't pass for headings.
STEP = (
    (0.90, 0.02, 0.02, 0.02, 0.04),
    (0.03, 0.90, 0.03, 0.03, 0.01),
    (0.03, 0.03, 0.90, 0.03, 0.01),
    (0.03, 0.03, 0.03, 0.90, 0.01),
    (0.84, 0.02, 0.02, 0.02, 0.10),
)


def _word_counts(flat) -> np.ndarray:
    """How many words, as blanks part them, each string of a large_string array without nulls has."""
    at = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    whole = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    blank = IS_BLANK[whole]
    begins = ~blank
    begins[1:] &= blank[:-1]
    head = at[:-1][np.diff(at) > 0]
    begins[head] = ~blank[head]
    return np.diff(np.searchsorted(np.flatnonzero(begins), at)).astype(np.float64)


def pieces(texts, odds: dict[str, float] | None = None) -> dict:
    """Of a pyarrow string array: ``offsets`` of each text's pieces; ``words``, ``addresses`` and ``features`` of each piece;
    ``word``, ``piece`` and ``times``, how often a word stands in a piece, in order of word and piece, ``fresh`` at a word's
    first piece on a page; and ``vocabulary``, in which ``known`` are the words that have odds."""
    import pyarrow as pa
    import pyarrow.compute as pc

    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.replace_substring_regex(low, r"([.!?…])[ \t]+", r"\1" + "\n")
    parts = pc.split_pattern_regex(low, r"[\r\n]+")
    offsets, flat = np.asarray(parts.offsets), parts.flatten()
    n = len(flat)

    def count(pattern: str) -> np.ndarray:
        return pc.count_substring_regex(flat, pattern).to_numpy(zero_copy_only=False).astype(np.float64)

    words, addresses = _word_counts(flat), count(ADDRESS)
    w = np.maximum(words, 1)
    ends = pc.match_substring_regex(flat, SENTENCE_END).to_numpy(zero_copy_only=False)
    tokens = pc.split_pattern_regex(flat, r"[^\p{L}\p{N}]+")
    coded = tokens.flatten().dictionary_encode()
    vocabulary, k = coded.dictionary, len(coded.dictionary)
    # One plain sort serves all counts of words: by piece, by page and in all (np.unique took 40 times as long).
    key = np.asarray(coded.indices).astype(np.int64) * max(1, n) + np.repeat(np.arange(n), np.diff(np.asarray(tokens.offsets)))
    key.sort()
    at = np.flatnonzero(np.diff(key, prepend=-1))
    times = np.diff(at, append=len(key))
    word, piece = np.divmod(key[at], max(1, n))
    page = np.repeat(np.arange(len(texts)), np.diff(offsets))[piece]
    fresh = (np.diff(word, prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0)
    of_page = np.cumsum(fresh) - 1
    on_page = np.bincount(of_page, times)[of_page]

    size = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False)[word]
    chars = size * (size >= LONG_WORD) * times
    whole = np.maximum(np.bincount(piece, chars, minlength=n), 1.0)
    inside, around = (np.bincount(piece, chars * marked, minlength=n) / whole for marked in (times > 1, on_page > 3))
    leaning, known = np.zeros(n), np.zeros(k, bool)
    if odds:
        place = pc.index_in(vocabulary, value_set=pa.array(list(odds), vocabulary.type)).fill_null(-1).to_numpy()
        known = place >= 0
        has = known[word]
        value = np.array(list(odds.values()))[place[word[has]]]
        leaning = np.bincount(piece[has], value * times[has], minlength=n) / np.maximum(np.bincount(piece[has], times[has], minlength=n), 1)
    shown = (addresses / w, count(SEPARATOR) / w, None, words, inside, around, leaning)
    features = np.stack([ends.astype(np.int64) if x is None else np.digitize(x, b, right=True) for x, b in zip(shown, BOUNDS, strict=True)], 1)
    return {"offsets": offsets, "words": words, "addresses": addresses, "features": features, "word": word, "piece": piece, "times": times, "fresh": fresh, "vocabulary": vocabulary, "known": known}


def start_model() -> dict:
    return {"emit": [np.log(np.array([s[f] for s in START])) for f in range(len(WIDTHS))], "step": np.log(np.array(STEP)), "first": np.log(np.array(FIRST)), "odds": {}}


def _scores(model: dict, p: dict) -> np.ndarray:
    score = sum(model["emit"][f][:, p["features"][:, f]] for f in range(len(WIDTHS))).T
    score[p["words"] == 0] = 0.0  # blank pieces say nothing
    return score


def _schedule(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pages by descending number of pieces: where they start, how many pieces they have, how many pages have a t-th piece."""
    n = np.diff(offsets)
    order = np.argsort(-n, kind="stable")
    n = n[order]
    longest = int(n[0]) if len(n) else 0
    alive = np.searchsorted(-n, -np.arange(longest), side="left")
    return offsets[:-1][order], n, alive


def label(model: dict, p: dict) -> np.ndarray:
    """Viterbi labels (index of STATES) of all pieces; pages advance together, one piece per step."""
    score = _scores(model, p)
    start, n, alive = _schedule(p["offsets"])
    out = np.zeros(len(score), np.int64)
    if not len(alive):
        return out
    back, state = np.zeros((len(score), len(START)), np.int8), np.zeros((len(n), len(START)))
    for t, k in enumerate(alive):
        at = start[:k] + t
        if t == 0:
            state[:k] = model["first"] + score[at]
            continue
        via = state[:k, :, None] + model["step"]
        back[at] = np.argmax(via, axis=1)
        state[:k] = np.max(via, axis=1) + score[at]
    cur = np.argmax(state, axis=1)
    for t in range(len(alive) - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        out[at] = cur[:k]
        cur[:k] = back[at, cur[:k]]
    return LABEL_OF[out]


def posteriors(model: dict, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: the probability of each state for every piece, and the expected transitions.

    Every piece's row is scaled to a sum of 1, so nothing underflows: no first state or transition has probability 0."""
    score = _scores(model, p)
    start, n, alive = _schedule(p["offsets"])
    seen = np.exp(score - score.max(1, keepdims=True))
    first, step = np.exp(model["first"]), np.exp(model["step"])
    ahead, behind = np.zeros_like(score), np.ones_like(score)
    for t, k in enumerate(alive):
        at = start[:k] + t
        x = seen[at] * (first if t == 0 else ahead[at - 1] @ step)
        ahead[at] = x / x.sum(1, keepdims=True)
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        x = (seen[at + 1] * behind[at + 1]) @ step.T
        behind[at] = x / x.sum(1, keepdims=True)
    z = ahead * behind
    inner = np.ones(len(score), bool)
    inner[p["offsets"][1:][np.diff(p["offsets"]) > 0] - 1] = False
    at = np.flatnonzero(inner)
    left, right = ahead[at], seen[at + 1] * behind[at + 1]
    left /= ((left @ step) * right).sum(1, keepdims=True)
    return z / z.sum(1, keepdims=True), step * (left.T @ right)


def counts(model: dict, texts, words: str = "all") -> tuple:
    """Expected counts over ``texts``, which add up over disjoint ones: keys, and for each (occurrences, expected count, pages).

    A key is a word (expected: in prose) or, after a tab, a place in the model; "\tpages" counts the texts. ``words``: "all",
    those "known" to have odds, or "none"."""
    import pyarrow as pa

    p = pieces(texts, model["odds"])
    z, moves = posteriors(model, p)
    use, n = p["words"] > 0, len(START)
    names, rows = [], []

    def add(name: str, value: np.ndarray) -> None:
        names.extend(f"\t{name} {i}" for i in range(value.size))
        rows.append(np.stack([np.zeros(value.size), value.ravel() * UNIT, np.zeros(value.size)], 1))

    for f, width in enumerate(WIDTHS):
        add(f"emit {f}", np.stack([np.bincount(p["features"][use, f], z[use, s], minlength=width) for s in range(n)]))
    add("step", moves)
    add("first", z[p["offsets"][:-1][np.diff(p["offsets"]) > 0]].sum(0))
    names.append("\tpages")
    rows.append(np.array([[0, 0, len(texts)]]))
    keys = pa.array(names, pa.string())
    if words != "none":
        word, k = p["word"], len(p["vocabulary"])
        good = np.bincount(word, z[:, LABEL_OF == 0].sum(1)[p["piece"]] * p["times"], minlength=k)
        took = np.flatnonzero(p["known"]) if words == "known" else np.arange(k)
        rows.append(np.stack([np.bincount(word, p["times"], minlength=k), good * UNIT, np.bincount(word[p["fresh"]], minlength=k)], 1)[took])
        keys = pa.concat_arrays([keys, p["vocabulary"].take(pa.array(took)).cast(pa.string())])
    return keys, np.rint(np.concatenate(rows)).astype(np.int64)


def words_of_round(r: int, rounds: int) -> str:
    """The words that round ``r`` counts. How often a word occurs and on how many pages is the same in every round, so the
    words that have odds after the first are those of all rounds; the last learns none."""
    return "none" if r == rounds - 1 else "known" if r else "all"


def updated(model: dict, sums: dict[str, tuple[int, int, int]], learn_words: bool) -> dict:
    """The model that the summed counts give, with START as a prior of PRIOR_WEIGHT pieces. Words keep their odds if not
    ``learn_words``: the emissions belong to the odds that the features were made with."""
    base, n = start_model(), len(START)

    def of(name: str, *shape: int) -> np.ndarray:
        return np.array([sums[f"\t{name} {i}"][1] for i in range(int(np.prod(shape)))], np.float64).reshape(shape) / UNIT

    emit = []
    for f, width in enumerate(WIDTHS):
        x = PRIOR_WEIGHT * np.exp(base["emit"][f])
        if model["odds"] or f < len(WIDTHS) - 1:  # before any word has odds, the last feature says nothing
            x += of(f"emit {f}", n, width)
        emit.append(np.log(x / x.sum(1, keepdims=True)))
    step = PRIOR_WEIGHT * np.exp(base["step"]) + of("step", n, n)
    first = PRIOR_WEIGHT * np.exp(base["first"]) + of("first", n)
    step = np.log(step / step.sum(1, keepdims=True))
    step[-1] = base["step"][-1]
    odds = model["odds"]
    if learn_words:
        pages = sums["\tpages"][2]
        least, on = max(WORD_COUNT, WORD_RATE * pages), max(WORD_PAGES, WORD_SHARE * pages)
        words = sorted(w for w, (whole, _, seen) in sums.items() if w and w[0] != "\t" and whole >= least and seen >= on)
        whole, good = (np.array([sums[w][i] for w in words], np.float64) / (1, UNIT)[i] for i in (0, 1))
        value = np.log((good + 1) / (good.sum() + len(words))) - np.log((whole - good + 1) / ((whole - good).sum() + len(words))) if words else whole
        odds = dict(zip(words, np.clip(value, -WORD_MOST, WORD_MOST).tolist(), strict=True))
    return {"emit": emit, "step": step, "first": np.log(first / first.sum()), "odds": odds}


def estimate(texts, rounds: int = ROUNDS) -> dict:
    """The model fitted to ``texts``, in this process."""
    model = start_model()
    for r in range(rounds):
        keys, n = counts(model, texts, words_of_round(r, rounds))
        model = updated(model, dict(zip(keys.to_pylist(), n.tolist(), strict=True)), r < rounds - 1)
    return model


def fitted(slim: DataFrame, rounds: int = ROUNDS) -> dict:
    """The model fitted to all texts of ``slim`` (doc, text); the counts of a round are summed by key."""
    model, total = start_model(), slim.count()
    for r in range(rounds):

        def run(batches: Iterator, model: dict = model, words: str = words_of_round(r, rounds)) -> Iterator:
            import pyarrow as pa

            for b in batches:
                for lo in range(0, b.num_rows, 2048):
                    keys, n = counts(model, b.slice(lo, 2048).column(1), words)
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array(n[:, i]) for i in range(3)]], names=["key", "whole", "good", "pages"])

        summed = slim.mapInArrow(run, "key string, whole bigint, good bigint, pages bigint").groupBy("key").agg(*[F.sum(c).alias(c) for c in ("whole", "good", "pages")])
        often = (F.col("whole") >= max(WORD_COUNT, WORD_RATE * total)) & (F.col("pages") >= max(WORD_PAGES, WORD_SHARE * total))
        kept = summed.where(F.col("key").startswith("\t") | often)  # bounded by WORD_SHARE
        sums = {x["key"]: (x["whole"], x["good"], x["pages"]) for x in kept.collect()}
        if not sums:
            return model
        model = updated(model, sums, r < rounds - 1)
    return model


def page_shares(df: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc``, ``words``, ``non_prose_words``, ``share`` the words of each state and the addresses, for every page.

    Whole texts are read. Null and empty texts, and texts of blanks, have no words and share 0. Repeated pages come out
    once each; other columns are ignored; an empty table gives no rows.
    """
    slim = df.select(F.col(doc).cast("bigint").alias("doc"), F.col(text).cast("string").alias("text"))
    model = fitted(slim)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                p = pieces(part.column(1), model["odds"])
                z = label(model, p)
                page = np.repeat(np.arange(part.num_rows), np.diff(p["offsets"]))
                by = [np.bincount(page, p["words"] * (z == s), minlength=part.num_rows).astype(np.int64) for s in range(4)]
                by.append(np.bincount(page, p["addresses"], minlength=part.num_rows).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, pa.int64()) for x in by]], names=["doc", *STATES, "addresses"])

    got = slim.mapInArrow(run, "doc bigint, " + ", ".join(f"{s} bigint" for s in (*STATES, "addresses")))
    every, rest = sum(F.col(s) for s in STATES), sum(F.col(s) for s in STATES[1:])
    return got.withColumn("words", every).withColumn("non_prose_words", rest).withColumn("share", F.round(F.when(every > 0, rest / every).otherwise(0.0), 6))


def spam_pages(df: DataFrame, doc: str, text: str, share: float = FLAG_SHARE) -> DataFrame:
    """Ids of the pages of which more than ``share`` of the words are not prose."""
    return page_shares(df, doc, text).where(F.col("share") > share).select("doc")
