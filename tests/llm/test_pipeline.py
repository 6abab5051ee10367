"""Each stage of the pipeline against its contract, on the smallest tables."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from barloom.llm import mixing, quality, token_output
from barloom.llm.common import read, stage

SF = "/root/testdata/sf0.001"


def ids(df) -> list:
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def firsts_of_groups(rows) -> list:
    """Brute force: the smallest identifier of each group of texts whose five-word shingle sets overlap by 3 in 4 or more."""
    sets, root = {}, {}
    for i, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
        root[i] = i

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return sorted(i for i in sets if top(i) == i)


def clean(rows, bench) -> list:
    """Brute force: documents of which less than a twentieth of the words is in windows of 13 benchmark words."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[k : k + 13]) for _, t in bench if (w := words(t)) for k in range(max(1, len(w) - 12))}
    out = []
    for i, t in rows:
        w, hit = words(t), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
        if not hit or 20 * len(hit) < len(w):
            out.append(i)
    return sorted(out)


def test_stages(spark):
    docs = read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    out = []
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        docs = stage(work(spark, docs, SF), f"t{k}")
        out.append(docs)
    documents = read(spark, SF, "documents")
    assert all(x.columns == documents.columns for x in out[:-1])
    labels = read(spark, SF, "labels")
    scores = {r.doc_id: r.score for r in quality.report(documents, labels).collect()}
    assert ids(out[0]) == sorted(i for i, s in scores.items() if s >= 0.3)
    assert ids(out[1]) == firsts_of_groups([(r.doc_id, r.text) for r in out[0].collect()])
    bench = [(r.item_id, r.text) for r in read(spark, SF, "benchmark").collect()]
    assert ids(out[2]) == clean([(r.doc_id, r.text) for r in out[1].collect()], bench)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(out[2]).collect()}
    expected = [i for i, (n, t) in taken.items() for _ in range(1 if n == 0 else -(-t // n))]
    assert ids(out[3]) == sorted(expected)
    assert [(r.doc_id, r.n_tokens) for r in out[4].orderBy("start").collect()] == [(r.doc_id, r.n_tokens) for r in token_output.report(out[3]).orderBy("start").collect()]


def test_run_is_the_stages(spark):
    a = {(r.doc_id, r.start, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()}
    assert a and len({s for _, s, _ in a}) == len(a)


SCHEMA = "doc_id long, text string, source string, copy string, n_shingles int, head boolean, size long"


def odd_rows() -> list[tuple]:
    """Null and repeated identifiers, nulls in every column, empty and repeated rows, clashing columns."""
    say = lambda c: " ".join(f"{c}{k}" for k in range(40))
    near = lambda t: t.replace("7", "", 1)
    texts = [(1, say("a")), (None, near(say("a"))), (None, say("b")), (None, say("c")), (2, say("d")), (2, say("e")), (2, say("e")), (3, near(say("e"))), (None, None), (None, ""), (4, None), (4, " "), (5, "two words"), (None, say("b"))]
    return [(i, t, "web" if k % 3 else None, None, None, None, k) for k, (i, t) in enumerate(texts)]


def test_one_row_of_each_group(spark):
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    done = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert done.columns == docs.columns
    got = sorted(((r.doc_id, r.text, r.size) for r in done.collect()), key=str)
    word = lambda t: bool((t or "").split())
    letter = lambda t: t.strip()[0] if word(t) else None
    # texts of one letter are near copies of each other: brute force by hand
    wanted = [(r[0], r[1], r[6]) for r in rows if not word(r[1])]
    for c in {letter(r[1]) for r in rows if word(r[1])}:
        group = [r for r in rows if letter(r[1]) == c]
        best = min(group, key=lambda r: (r[0] is None, r[0] or 0, r[2] is not None, r[2] or "", r[6]))
        wanted.append((best[0], best[1], best[6]))
    assert got == sorted(wanted, key=str)


def test_stages_of_odd_and_empty_tables(spark):
    docs = spark.createDataFrame(odd_rows(), SCHEMA)
    for name, work in corpus_pipeline.STAGES:
        assert work(spark, docs.limit(0), SF).count() == 0, name
        if name != "n-gram Jaccard join":
            done = work(spark, docs, SF)
            assert name.startswith("token") or done.columns == docs.columns
    assert corpus_pipeline.good_documents(spark, docs, SF).count() <= docs.count()
    taken = sorted(((r.doc_id, r.size, r.taken) for r in mixing.mix(docs).collect()), key=str)
    times = Counter((r.doc_id, r.text or "") for r in corpus_pipeline.mixed(spark, docs, SF).collect())
    by_row = defaultdict(list)
    for i, t, source, *_ in odd_rows():
        n = len((t or "").split())
        by_row[i, t or ""].append(n)
    total = {k: sum(-(-t // n) if n else 1 for _, n, t in [x for x in taken if x[0] == k[0] and x[1] == v[0]][:1]) for k, v in by_row.items() if len(v) == 1 and sum(x[0] == k[0] and x[1] == v[0] for x in taken) == 1}
    assert total and {k: times[k] for k in total} == total
    assert corpus_pipeline.tokens(spark, docs, SF).count() == docs.count()
    assert corpus_pipeline.without_benchmark(spark, docs, SF).count() == docs.count()


def test_mix_keeps_own_columns(spark):
    r = random.Random(1)
    rows = [(k, " ".join("w" for _ in range(r.randrange(9))), r.choice("ab"), 1, 2, 3) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int, copy_number int, mix_id int")
    done = corpus_pipeline.mixed(spark, docs, SF)
    assert done.columns == docs.columns
    assert ids(done.where("text = ''")) == sorted(k for k, t, *_ in rows if t == "")
