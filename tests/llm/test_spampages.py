import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from weftgraph.llm import spampages as S

PROSE = "The court held that the statute was not binding on the foundry. She said that it had been reviewed by two people.\nNobody at the institute could say why the inventory had grown."
LINKS = "\n".join(f"* [cheap water filter](https://water-filter{i}.example/{i})" for i in range(15))
TAGS = "buy yoga mat / cheap yoga mat / yoga mat online / best dog collar / " * 12
MENU = "\n".join(f"AB-{i} bike helmet {i}.99" for i in range(20))
LIST = "\n".join(f"{i}. The dose was lowered to {i} milligrams once the group had been told about it." for i in range(10))


def flagged(spark, rows):
    df = spark.createDataFrame([(*r, 1, "w") for r in rows], "id bigint, body string, doc int, words string")
    return sorted(r["doc"] for r in S.spam_pages(df, "id", "body").collect())


def test_kinds(spark):
    rows = [(1, PROSE), (2, LINKS), (3, TAGS), (4, MENU), (5, LIST), (6, PROSE + "\n" + LINKS), (7, TAGS), (8, None), (9, ""), (10, " \n "), (11, "Glossary"), (12, (PROSE + "\n") * 30 + TAGS), (13, (PROSE + "\n") * 3000)]
    assert flagged(spark, rows) == [2, 3, 4, 6, 7]


def test_empty_table(spark):
    assert flagged(spark, []) == []


def test_shares_add_up(spark):
    df = spark.createDataFrame([(1, PROSE + "\n" + TAGS), (1, PROSE)], "id bigint, t string")
    for r in S.page_shares(df, "id", "t").collect():
        assert r["words"] == sum(r[s] for s in S.STATES) and r["words"] - r["prose"] == r["non_prose_words"]


def of(*texts, model=None):
    p = S.pieces(pa.array(list(texts), pa.string()), (model or {}).get("odds"))
    z = S.label(model or S.start_model(), p)
    page = np.repeat(np.arange(len(texts)), np.diff(p["offsets"]))
    return [float((p["words"] * (z > 0))[page == i].sum() / max(1, p["words"][page == i].sum())) for i in range(len(texts))]


def test_prose_of_languages_that_no_list_names():
    finnish = "Eilen satoi lunta koko päivän ja illalla tuuli yltyi myrskyksi. Lapset jäivät kotiin lukemaan vanhoja kirjoja isoäidin kanssa. Aamulla naapuri auttoi meitä kaivamaan auton esiin hangesta."
    polish = "Wczoraj wieczorem spotkaliśmy się z nauczycielem historii przed starą biblioteką w centrum miasta\nOpowiadał nam długo o swojej podróży przez góry i o ludziach których tam poznał\nDopiero po północy wróciliśmy zmęczeni do domu ostatnim pociągiem"
    assert of(finnish, polish) == [0.0, 0.0]


def test_lists_and_stuffing():
    links = "\n".join(f"item {i} - https://shop-{i}.example/{i}" for i in range(12))
    stuffed = "Red lamp red lamp cheap red lamp desk lamp. Desk lamp red lamp buy lamp cheap desk lamp. Cheap lamp red lamp desk lamp buy red lamp. Buy desk lamp red lamp cheap lamp lamp."
    tags = ", ".join(["red lamp", "desk lamp", "cheap lamp", "buy lamp"] * 8)
    assert all(x > 0.5 for x in of(links, stuffed, tags))
    assert of("Glossary", "Chapter one", "", None) == [0.0, 0.0, 0.0, 0.0]


def test_forward_backward_and_viterbi_against_enumeration():
    model = S.start_model()
    p = S.pieces(pa.array(["Title\nA sentence of prose stands here.\nred lamp | desk lamp", "one, one, one\nhttps://a.example"]))
    score, n = S._scores(model, p), len(S.START)
    z, moves = S.posteriors(model, p)
    total = np.zeros((n, n))
    for a, b in zip(p["offsets"][:-1], p["offsets"][1:], strict=True):
        paths = list(itertools.product(range(n), repeat=b - a))
        value = np.array([model["first"][q[0]] + sum(score[a + i, s] for i, s in enumerate(q)) + sum(model["step"][x, y] for x, y in itertools.pairwise(q)) for q in paths])
        weight = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
        for i in range(b - a):
            for s in range(n):
                assert abs(z[a + i, s] - sum(w for w, q in zip(weight, paths, strict=True) if q[i] == s)) < 1e-9
        for w, q in zip(weight, paths, strict=True):
            for x, y in itertools.pairwise(q):
                total[x, y] += w
        assert list(S.label(model, p)[a:b]) == [S.LABEL_OF[s] for s in paths[int(np.argmax(value))]]
    assert np.abs(moves - total).max() < 1e-9


def test_words_are_learned():
    rnd = random.Random(3)
    glue, nouns, sale = ["ka", "lo", "mi", "tu"], [f"noun{i}" for i in range(40)], ["zap", "bim", "kro"]
    prose = [" ".join(w for _ in range(6) for w in (rnd.choice(nouns), rnd.choice(glue))) + "." for _ in range(300)]
    lists = ["\n".join(f"{rnd.choice(sale)} {rnd.choice(nouns)} | https://x{i}.example" for i in range(8)) for _ in range(40)]
    model = S.estimate(pa.array(["\n".join(prose[i : i + 3]) for i in range(0, 300, 3)] + lists))
    assert min(model["odds"][g] for g in glue) > 1 and max(model["odds"][x] for x in sale) < -1


def test_all_pages_count(spark):
    """The counts that Spark sums are those of all pages at once: no page is left out, however many there are."""
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["ka", "lo", "noun", "verb"]) + str(rnd.randrange(30)) for _ in range(6)) + "." for _ in range(6000)]
    texts += [f"zap kro {i} | https://x{i}.example" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc bigint, text string").repartition(3)
    got, want = S.fitted(df), S.estimate(pa.array(texts))
    assert got["odds"].keys() == want["odds"].keys() and all(abs(got["odds"][w] - v) < 1e-4 for w, v in want["odds"].items())
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got["emit"], want["emit"], strict=True)) and np.allclose(got["step"], want["step"], atol=1e-4)


def test_words_are_counted_in_full_once(monkeypatch):
    """Occurrences and pages don't depend on the model: after the first round only the words that have odds are counted, and
    none in the last, which learns none."""
    rnd = random.Random(5)
    texts = pa.array([" ".join(rnd.choice(["ka", "lo", "mi"]) + " " + f"noun{rnd.randrange(500)}" for _ in range(6)) + "." for _ in range(200)])
    seen, counts = [], S.counts

    def watched(*args, **more):
        keys, n = counts(*args, **more)
        seen.append({str(k) for k in keys if not str(k).startswith("\t")})
        return keys, n

    monkeypatch.setattr(S, "counts", watched)
    odds = S.estimate(texts)["odds"]
    assert odds and len(seen[0]) > len(odds) and seen[1:] == [odds.keys(), set()]


def test_pieces_against_plain_python():
    texts = ["Lamp lamp LAMP élan. Second line here\n\nlamp\x0blamp  lamp\tgo\x0c!", None, "", " \n ", "a-b a-b", "ÉÉÉÉÉ ééééé\r\nlamp", "word " * 30]
    odds = {"lamp": 1.0, "go": -2.0, "a": 0.25}
    p, at = S.pieces(pa.array(["left out", *texts]).slice(1), odds), 0
    for text, lo, hi in zip(texts, p["offsets"][:-1], p["offsets"][1:], strict=True):
        lines = [x for line in re.split(r"[\r\n]+", (text or "").lower()) for x in re.split(r"(?<=[.!?…])[ \t]+", line)]
        page = Counter(w for x in lines for w in re.findall(r"[^\W_]+", x))
        assert hi - lo == len(lines)
        for x in lines:
            own = Counter(re.findall(r"[^\W_]+", x))
            long = {w: n for w, n in own.items() if len(w) >= S.LONG_WORD}
            letters = max(1, sum(len(w) * n for w, n in long.items()))
            has = [odds[w] for w in own.elements() if w in odds]
            shown = (
                sum(len(w) * n for w, n in long.items() if n > 1) / letters,
                sum(len(w) * n for w, n in long.items() if page[w] > 3) / letters,
                sum(has) / max(1, len(has)),
            )
            assert p["words"][at] == len(re.findall(r"[^\t\n\f\r ]+", x))
            assert list(p["features"][at, 4:]) == [int(np.digitize(v, b, right=True)) for v, b in zip(shown, S.BOUNDS[4:], strict=True)], x
            at += 1
    assert at == len(p["words"])
