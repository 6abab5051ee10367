"""Quality rules, token alignment and conversation repair against brute force, on odd tables and long texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from barloom.llm import alignment, conversations, quality_rules
from barloom.llm.token_output import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, id long, words string, votes int, n_words string, block int, pair string"
TALKS = "conv_id long, turn long, role string, text string, copies_of int, first string"


def documents() -> list[tuple]:
    r = random.Random(5)
    vocabulary = "the of and to a word house green runs over der die und el los ### %%% && | THE RUN".split()
    say = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    texts = [None, "", "   ", "\n\n", "one", "a b c", "a b c a b c", "a a a a a a", say(20_000), "x " * 70, "\n".join([say(8)] * 9), "line\nline\n\nline \nline", "#" * 50, " lead and trail. "]
    texts += [". ".join(say(r.randrange(3, 12)).capitalize() for _ in range(r.randrange(1, 15))) + "." for _ in range(60)]
    texts += [texts[20], texts[20]]
    ids: list[int | None] = list(range(len(texts)))
    ids[3], ids[5], ids[21] = None, None, ids[20]
    return [(i, t, 1, "w", 2, "n", 3, "p") for i, t in zip(ids, texts, strict=True)]


def brute_signals(text: str | None) -> dict:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(words) - 2):
        windows[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_capitals": len(re.findall("[A-Z]", text)), "n_letters": len(re.findall("[A-Za-z]", text)),
        "n_ends": sum(w[-1] in ".!?" for w in words), "n_function": sum(w.lower() in quality_rules.FUNCTION_WORDS for w in words), "n_distinct": len(set(words)),
    }


def brute_verdicts(signals: list[dict]) -> list[tuple[bool, bool]]:
    """Plain expectation-maximisation over all rows, one by one."""

    def test(sql: str, row: dict) -> bool:
        return bool(eval(sql.replace(" AND ", " and ").replace(" OR ", " or ").replace(" = ", " == "), {}, row))

    rules = quality_rules.RULES
    votes = np.array([[0 if test(r.bad, s) else 1 if test(r.good, s) else 2 for r in rules] for s in signals])
    share, weight = quality_rules.START_SHARE, quality_rules.WEIGHT
    on_good, on_bad = np.full(len(rules), quality_rules.START_GOOD), np.full(len(rules), quality_rules.START_BAD)

    def posterior() -> np.ndarray:
        good = np.where(votes == 1, on_good, np.where(votes == 0, 1 - on_good, 1)).prod(axis=1) * share
        bad = np.where(votes == 1, 1 - on_bad, np.where(votes == 0, on_bad, 1)).prod(axis=1) * (1 - share)
        return good / (good + bad)

    for _ in range(quality_rules.STEPS):
        q = posterior()[:, None]
        rate = lambda hit, every, start: (hit.sum(axis=0) + start * weight) / (every.sum(axis=0) + weight)
        voted = votes != 2
        share, on_good, on_bad = (
            float((q.sum() + quality_rules.START_SHARE * weight) / (len(q) + weight)),
            rate(q * (votes == 1), q * voted, quality_rules.START_GOOD),
            rate((1 - q) * (votes == 0), (1 - q) * voted, quality_rules.START_BAD),
        )
    good = posterior()
    failed = [test(quality_rules.BASE_FAILED, s) for s in signals]
    return [(f, not f and g >= quality_rules.THRESHOLD) for f, g in zip(failed, good, strict=True)]


def test_quality_rules_against_brute_force(spark):
    rows = documents()
    got = quality_rules.judged(spark.createDataFrame(rows, DOCS).repartition(3))[0].collect()
    signals = [brute_signals(r[1]) for r in rows]
    wanted = [(r[0], *[s[c] for c in quality_rules.SIGNALS], *v) for r, s, v in zip(rows, signals, brute_verdicts(signals), strict=True)]
    found = [(r.doc_id, *[r[c] for c in quality_rules.SIGNALS], r.base_failed, r.kept) for r in got]
    assert sorted(found, key=str) == sorted(wanted, key=str)


def test_quality_rules_on_an_empty_table(spark):
    assert quality_rules.report(spark.createDataFrame([], DOCS)).collect() == []


def test_rules_learn_who_is_right(spark):
    """Two rules that tell good from bad and one that votes at random: its accuracy is found, and it decides nothing."""
    r = random.Random(3)
    votes, truth = [], []
    for _ in range(3000):
        good = r.random() < 0.8
        own = [int(good) if r.random() < 0.97 else int(not good) for _ in range(4)]
        votes.append(([*own, r.randrange(2)],))
        truth.append(good)
    rows = spark.createDataFrame(votes, "votes array<int>")
    model = quality_rules.fit(rows, 5)
    assert abs(model.share - 0.8) < 0.04 and all(x > 0.9 for x in (*model.on_good[:4], *model.on_bad[:4])) and abs(model.on_good[4] - 0.5) < 0.05
    kept = rows.select((model.posterior() >= 0.5).alias("k"), "votes").collect()
    assert np.mean([k.k == t for k, t in zip(kept, truth, strict=True)]) > 0.98


def brute_alignment(texts: list[str | None]) -> list[tuple]:
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = alignment.sides(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    a = Tokenizer.from_file(tokenizer_path())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    done, links = [], []
    for text in texts:
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            raw = [[side.encoder.bytes[i] for i in x] for side, x in zip((one, two), ids, strict=True)]
        if not text or any(b"".join(x) != (" " + text).encode() for x in raw):
            done.append((0, 0, 0, 0, ""))
            links.append(Counter())
            continue
        ends = [list(itertools.accumulate(map(len, x))) for x in raw]
        groups, held, x, y = [], Counter(), 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x2, y2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
            groups.append(",".join(map(str, ids[0][x:x2])) + "|" + ",".join(map(str, ids[1][y:y2])))
            held.update(itertools.product(ids[0][x:x2], ids[1][y:y2]))
            x, y = x2, y2
        done.append((len(ids[0]), len(ids[1]), len(groups), sum(held.values()), hashlib.sha256(";".join(groups).encode()).hexdigest()))
        links.append(held)
    count = Counter(p for held in links for p in held)
    most: dict[int, int] = defaultdict(int)
    for (i, _), n in count.items():
        most[i] = max(most[i], n)
    return [(*d, sum(n for p, n in held.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in held.items())) for d, held in zip(done, links, strict=True)]


def odd_texts(n: int, seed: int) -> list[str]:
    r = random.Random(seed)
    parts = ["a", " ", "  ", "\n", "\t", "é", "日本", "word", "the", "ing", ".", "!!", "###", "▁", "<|endoftext|>", "<s>", "<0x41>", "　", " ", "😀", "é", "0", "123", "ß", "\x00", "\r\n", "don't", "_", "کتاب", "�", " b ", "   "]
    return ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(n)]


def test_alignment_against_brute_force(spark):
    texts: list[str | None] = [None, "", " ", "   ", "a▁b", "x" * 3000, " " * 400, "aé" * 300, "word " * 20_000, *odd_texts(400, 2)]
    rows = [(None if k % 50 == 7 else k, t, 1, "w", 2, "n", 3, "p") for k, t in enumerate(texts)] + [(9, texts[9], 1, "w", 2, "n", 3, "p")]
    got = alignment.report(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    wanted = brute_alignment([r[1] for r in rows])
    found = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256, r.n_best, r.count_sum) for r in got]
    assert sorted(found, key=str) == sorted(((r[0], *w) for r, w in zip(rows, wanted, strict=True)), key=str)
    assert alignment.report(spark.createDataFrame([], DOCS)).collect() == []


def test_large_groups_count_ids_first(monkeypatch):
    one, two = alignment.sides(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    texts = pa.array(odd_texts(300, 8), pa.string())
    told = lambda: {(r, p): n for r, p, n in zip(*(x.tolist() for x in alignment.Aligned(texts, one, two).pairs(two.encoder.size)), strict=True)}
    few = told()
    monkeypatch.setattr(alignment, "FEW", 1)
    assert told() == few


def test_blocks_may_be_small(spark, monkeypatch):
    texts = odd_texts(60, 4)
    rows = [(k, t, 1, "w", 2, "n", 3, "p") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(1)
    want = sorted(alignment.report(docs).collect(), key=str)
    held = alignment._aligned_blocks(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    monkeypatch.setattr(alignment, "BATCH_BYTES", 200)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 400)

    class Task:
        @staticmethod
        def get():
            return type("T", (), {"partitionId": staticmethod(lambda: 3)})

    monkeypatch.setattr(alignment, "TaskContext", Task)
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["id", "text"])
    blocks = list(held(iter([batch])))
    assert len(blocks) > 3 and [d for b in blocks for d in b.column("doc_id").to_pylist()] == list(range(60))
    assert sorted((d, s) for b in blocks for d, s in zip(b.column("doc_id").to_pylist(), b.column("groups_sha256").to_pylist(), strict=True)) == sorted((r.doc_id, r.groups_sha256) for r in want)


def test_aligned_groups_cover_the_text(spark):
    rows = [(1, "ab cd", 1, "w", 2, "n", 3, "p"), (2, "", 1, "w", 2, "n", 3, "p"), (3, "naïve 日本", 1, "w", 2, "n", 3, "p")]
    got = alignment.aligned_groups(spark.createDataFrame(rows, DOCS)).orderBy("doc_id", "at").collect()
    for doc, text in ((1, "ab cd"), (3, "naïve 日本")):
        mine = [r for r in got if r.doc_id == doc]
        assert [r.at for r in mine] == list(range(len(mine))) and mine[0].start == 0 and mine[-1].end == len((" " + text).encode())
        assert all(x.end == y.start for x, y in itertools.pairwise(mine))
    assert {r.doc_id for r in got} == {1, 3}


def talks() -> list[tuple]:
    r = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    texts = ["Hi.", "Yes!", "cut off", "", " ", None, "Why?", "end. \n", "no end\t"]
    rows = []
    for conv in [*range(120), None]:
        for turn in r.sample(range(-2, 9), r.randrange(1, 5)):
            rows.append((conv, None if r.random() < 0.08 else turn, r.choice(roles), r.choice(texts), 1, "f"))
    rows.append((500, -(2**63), "user", "far.", 1, "f"))
    rows.append((500, 2**63 - 1, "assistant", "away.", 1, "f"))
    rows += rows[:12]
    return rows


def after_damage(rows: list[tuple]) -> dict:
    held: dict = {r[0]: [] for r in rows}
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        held[conv] += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return {c: sorted(rs, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, rs in held.items()}


def brute_repair(rows: list[tuple]) -> tuple:
    """All edits with at most two inserted turns between rows, the cheapest and then least of them."""
    seen: set = set()
    kinds = []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    for edits in itertools.product("KRD", repeat=len(rows)):
        if any(k in ("blank", "duplicate") and e != "D" for k, e in zip(kinds, edits, strict=True)):
            continue
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:], strict=True))
            cost = sum({"R": 3, "D": 4, "I": 3, "K": 0}[e] for e in audit) + sum(3 for k, e in zip(kinds, edits, strict=True) if k == "truncated" and e != "D")
            if best is not None and (cost, audit) >= best[:2]:
                continue
            out, todo = [], iter(rows)
            for e in audit:
                row = None if e == "I" else next(todo)
                if e == "D":
                    continue
                asked = "assistant" if out and out[-1][0][:1] == "u" else "user"
                out.append((row[1], row[2]) if e == "K" else (asked, row[2] if row else ""))
            if re.fullmatch("(s?(ua)+)?", "".join(role[:1] or "-" for role, _ in out)):
                best = cost, audit, "\n".join(f"{role}:{text}" for role, text in out)
    turns = [t for t, *_ in rows if t is not None]
    pairs = [x[1][:1] + y[1][:1] for x, y in itertools.pairwise(rows)]
    gaps = min(max(turns) - min(turns) + 1 - len(set(turns)), 2**63 - 1) if turns else 0
    count = Counter(kinds)
    return gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def test_repair_against_brute_force(spark):
    rows = talks()
    got = {r.conv_id: tuple(r)[1:] for r in conversations.report(spark.createDataFrame(rows, TALKS).repartition(4)).collect()}
    wanted = {c: brute_repair(rs) for c, rs in after_damage(rows).items() if len(rs) <= 5}
    assert set(got) == {r[0] for r in rows} and len(wanted) > 90
    assert {c: got[c] for c in wanted} == wanted
    assert conversations.report(spark.createDataFrame([], TALKS)).collect() == []


def test_repair_sql_agrees_on_odd_rows(spark):
    rows = [r for r in talks() if r[0] != 500]
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    con.executemany("insert into conversations values (?, ?, ?, ?)", [r[:4] for r in rows])
    found = con.execute(conversations.ORACLE)
    names = [x[0] for x in found.description]
    wanted = {tuple(dict(zip(names, r, strict=True))[c] for c in (x.split()[0] for x in conversations.REPORT.split(", ")) if c != "roles") for r in found.fetchall()}
    assert {tuple(r) for r in conversations.report(spark.createDataFrame(rows, TALKS)).collect()} == wanted


def test_folding_changes_nothing(monkeypatch):
    """Long conversations give their texts and shared edits away early: the same report as when all is held."""
    r = random.Random(9)
    turns = [(k, r.choice(["user", "assistant", "user", "system"]), r.choice(["yes.", "cut", "no!", f"{k}."])) for k in range(900)]
    reports = []
    for most in (10**9, 1, 7):
        monkeypatch.setattr(conversations, "FOLD_TURNS", most)
        talk, seen = conversations.Conversation(1), set()
        for turn, role, text in turns:
            talk.add(turn, role, text, (role, text) in seen)
            seen.add((role, text))
        reports.append(talk.row())
    assert reports[0] == reports[1] == reports[2]
    held = conversations.Conversation(2)
    for k in range(3000):
        held.add(k, "ua"[k % 2], f"{k}.", False)
    held._fold()
    assert all(len(p.audit) < 10 for p in held.paths if p is not None)


def test_repaired_turns_are_what_the_hash_says(spark):
    rows = conversations.damaged(spark.createDataFrame([r for r in talks() if r[0] != 500], TALKS))
    report = conversations.repaired(rows)
    turns = defaultdict(list)
    for r in conversations.repaired_turns(rows, report).collect():
        turns[r.conv_id].append((r.position, f"{r.role}:{r.text}"))
    for r in report.collect():
        mine = sorted(turns[r.conv_id])
        assert [k for k, _ in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(t for _, t in mine).encode()).hexdigest() == r.repaired_sha256


@pytest.mark.parametrize("seed", range(3))
def test_piece_encoder_is_the_library(seed):
    one, two = alignment.sides(tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))
    texts = [t for t in odd_texts(500, 20 + seed) if t and "▁" not in t]
    ids, counts = two.encoder.encode(pa.array([" " + t for t in texts]))
    edge = np.concatenate([[0], np.cumsum(counts)])
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(edge)] == two.encoder.model.encode(texts)


def hot_rows() -> list[tuple]:
    """Half the identifiers null, a third of the rest repeated."""
    r = random.Random(6)
    say = lambda k: " ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(k))
    return [(None if k % 2 else (7 if k % 3 else k), say(r.randrange(1, 60)), 1, "w", 2, "n", 3, "p") for k in range(400)]


def test_tokens_of_hot_identifiers_have_one_order(spark):
    from barloom.llm import token_output

    rows = hot_rows()
    docs = spark.createDataFrame(rows, DOCS)
    runs = [sorted(token_output.report(docs.repartition(n)).collect(), key=lambda r: r.start) for n in (2, 5)]
    assert runs[0] == runs[1] and len(runs[0]) == len(rows)
    assert [r.start for r in runs[0]] == [0, *itertools.accumulate(r.n_tokens for r in runs[0])][:-1]
    assert [r.doc_id is None for r in runs[0]] == sorted([r.doc_id is None for r in runs[0]], reverse=True)
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    crc = lambda t: zlib.crc32(np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in runs[0]) == Counter((r[0], crc(r[1])) for r in rows)


def test_stores_are_known_by_hadoops_names():
    from barloom.llm import token_output

    named = [token_output.known_uri(u) for u in ("s3a://bucket/x", "s3n://bucket/x", "dbfs:/mnt/x", "dbfs:///mnt/x", "file:///tmp/x", "hdfs://host/x")]
    assert named == ["s3://bucket/x", "s3://bucket/x", "file:///dbfs/mnt/x", "file:///dbfs/mnt/x", "file:///tmp/x", "hdfs://host/x"]
    assert token_output._filesystem("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises(ValueError, match="no file system"):
        token_output._filesystem("nowhere://x/y")


def test_mix_of_hot_identifiers_spreads_and_agrees(spark):
    from barloom.llm import mixing

    rows = hot_rows()
    docs = spark.createDataFrame(rows, DOCS).selectExpr("doc_id", "text", "id", "words AS source")
    runs = [Counter(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (2, 5)]
    assert runs[0] == runs[1] and sum(runs[0].values()) == len(rows)
    size = sum(len(WORD.findall(r[1])) for r in rows)
    assert sum(t * n for (*_, t), n in runs[0].items()) == int(1.5 * size)
    assert all(taken <= 2 * own for _, own, _, _, taken in runs[0])


def test_repeats_of_hot_identifiers(spark):
    from barloom.llm import substring_dedup

    rows = hot_rows() + [(3, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 1, "w", 2, "n", 3, "p")]
    rows += [(None, "x " + rows[-1][1] + " y", 1, "w", 2, "n", 3, "p"), (5, "z " + rows[-1][1], 1, "w", 2, "n", 3, "p")]
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.report(spark.createDataFrame(rows, DOCS).repartition(4)).collect())
    key = lambda i: 2**63 if i is None else i
    least: dict[tuple, int] = {}
    for i, text, *_ in rows:
        words = text.split()
        for k in range(len(words) - 12):
            w = tuple(words[k : k + 13])
            least[w] = min(least.get(w, 2**64), key(i))
    wanted = Counter()
    for i, text, *_ in rows:
        words = text.split()
        gone = {k + j for k in range(len(words) - 12) if least[tuple(words[k : k + 13])] < key(i) for j in range(13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        wanted[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    assert got == wanted and sum(n * c for (_, _, n, _), c in got.items()) > 20
    assert substring_dedup.doubled(substring_dedup.FIRST, substring_dedup.WINDOW) == [4, 8, 13]


def test_variants_of_a_line_are_one_set(spark):
    """Thousands of case and spacing variants of one short line: equal sets are linked without meeting in tiles."""
    from barloom.llm import ngram_join

    line = "the quick brown fox jumps over the lazy dog again"
    rows = [(k, "".join(c.upper() if (k >> j) & 1 else c for j, c in enumerate(line)) + " " * (k >> 12), 1, "w", 2, "n", 3, "p") for k in range(5000)]
    rows += [(9000, line + " and then it slept", 1, "w", 2, "n", 3, "p"), (9001, "another line that says something else entirely here", 1, "w", 2, "n", 3, "p")]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(rows, DOCS).repartition(4)).collect()}
    assert len(got) == len(rows) and all(got[k] == 0 for k in range(5000)) and got[9000] == 9000 and got[9001] == 9001


def test_tiles_join_classes_in_any_order():
    from barloom.llm import ngram_join

    r = random.Random(1)
    base = [np.unique(np.array([r.getrandbits(64) for _ in range(20)], np.uint64)) for _ in range(6)]
    sets = []
    for k in range(120):
        s = base[k % 6].copy()
        s[r.randrange(len(s))] = r.getrandbits(64)
        sets.append(np.unique(s))
    ids = np.arange(120)
    links = ngram_join.links_in_tile(ids, ids, sets)
    label = list(range(120))
    for a, b in links:
        low, high = sorted((label[a], label[b]))
        label = [low if x == high else x for x in label]
    wanted = list(range(120))
    for a, b in itertools.combinations(range(120), 2):
        both = len(np.intersect1d(sets[a], sets[b]))
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            low, high = sorted((wanted[a], wanted[b]))
            wanted = [low if x == high else x for x in wanted]
    assert label == wanted and len(links) == 120 - len(set(label))


ENGLISH = (
    "time people way water words day part number sound place year work name home small end house mother world school food study night light idea "
    "mountain price market city garden music letter river winter summer paper engine bridge doctor student"
).split()


def english_page(r: random.Random, mark: str) -> str:
    """A page made apart from the labeller's own: English words, nested divs whose names say nothing or mislead, short lists, tables."""
    say = lambda a, b: " ".join(r.choice(ENGLISH) for _ in range(r.randint(a, b))).capitalize()
    names = lambda: r.choice(["", f" class='sc-{r.getrandbits(20):x}'", f" class='css-{r.getrandbits(20):x} x{r.randrange(9)}'", f" data-id='comment-{r.randrange(99)}'", " data-class='sidebar'"])
    wrap = lambda s, k: "".join(f"<div{names()}>" for _ in range(k)) + s + "</div>" * k
    links = lambda n: "<ul>" + "".join(f"<li><a href='#'>{say(1, 3)}</a></li>" for _ in range(n)) + "</ul>"
    top = [wrap(links(r.randint(3, 7)), r.randint(1, 3)), wrap("<p>We use cookies to improve this site. Accept all cookies?</p><button>Accept</button>", r.randint(1, 2)), wrap(f"<a href='/'>{say(1, 2)}</a>", 1)]
    end = [wrap(f"<p>Copyright 2024 {say(1, 2)}. All rights reserved.</p>", r.randint(1, 2)), wrap("<h3>Related</h3>" + links(r.randint(2, 5)), r.randint(1, 3)), wrap("<form><label>Subscribe to our newsletter</label></form>", 1)]
    body = [f"<h1>{mark}{say(3, 8)}</h1>"]
    for _ in range(r.randint(3, 12)):
        body.append(
            r.choice(
                [lambda: f"<p>{mark}{say(12, 60)}. {say(8, 30)}.</p>"] * 7
                + [
                    lambda: "<ul>" + "".join(f"<li>{mark}{say(1, 4)}</li>" for _ in range(r.randint(2, 5))) + "</ul>",
                    lambda: f"<h2>{mark}{say(2, 5)}</h2><p>{mark}{say(15, 40)}.</p>",
                    lambda: "<table>" + "".join(f"<tr><td>{mark}{say(1, 2)}</td><td>{mark}{say(1, 3)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>",
                ]
            )()
        )
    r.shuffle(top), r.shuffle(end)
    return "<html><body>" + "".join(x for x in top if r.random() < 0.8) + wrap("".join(body), r.randint(1, 4)) + "".join(x for x in end if r.random() < 0.8) + "</body></html>"


def test_articles_without_telling_names():
    from barloom.llm import html_extract

    model, r = html_extract.trained(), random.Random(1)
    right = wrong = 0
    for _ in range(200):
        blocks = html_extract.Blocks(english_page(r, html_extract.MARK))
        main = html_extract.truth(blocks) > 0
        got = html_extract.label(model, [blocks])[0] >= 0.5
        right, wrong = right + 2 * int((got & main).sum()), wrong + int((got != main).sum())
    assert right / (right + wrong) > 0.95  # F1

    def kept(page: str) -> list[str]:
        blocks = html_extract.Blocks(page)
        return [t for t, s in zip(blocks.texts, html_extract.label(model, [blocks])[0], strict=True) if s >= 0.5]

    article = ["The long winter of the north", "The snow came early that year and nobody in the valley had stored enough wood for the months ahead of them.",
               "By the middle of the season the road was closed, and the letters that people sent came back unopened.", "When spring arrived at last they counted what was left and began again."]
    body = f"<h1>{article[0]}</h1>" + "".join(f"<p>{t}</p>" for t in article[1:])
    around = "<div class='ck'><p>We use cookies on this site. Accept?</p></div><div class='mn'><ul><li><a href='/'>Home</a></li><li><a href='/a'>About</a></li></ul></div>"
    # a line of copyright in a div of any name may stay
    found = kept(f"<body>{around}<div class='sc-a'>{body}</div><div class='ft'><p>Copyright 2024 Example. All rights reserved.</p></div></body>")
    assert [t for t in found if not t.startswith("Copyright")] == article
    assert kept(f"<article data-id='comment-ad' data-class='sidebar'>{body}</article>") == kept(f"<article data-id='17'>{body}</article>") == article
    soup = ["Soup", "Take a large pot and fill it with water, then wait until it boils.", "salt", "flour", "two onions", "Cook it for an hour and serve it hot to all of your friends."]
    assert kept(f"<article><h1>{soup[0]}</h1><p>{soup[1]}</p><ul><li>salt</li><li><a href='/f'>flour</a></li><li>two onions</li></ul><p>{soup[5]}</p></article>") == soup


def test_only_own_attributes_name_a_tag():
    from barloom.llm.html_extract import Blocks

    told = lambda tag: Blocks(f"<{tag}>x</div>").told[0]
    assert told("div class=sidebar") == told('div  CLASS = "a sidebar"') == told("div title='x' id='sidebar'") != 0
    assert told("div data-class='sidebar'") == told("div title=\"class='sidebar'\"") == told("div xid=sidebar") == told("div") == 0


def brute_mix(rows: list[tuple]) -> dict:
    """taken by identifier: targets by water-filling, documents in the order of their keys, counted word by word."""
    size = {i: len(WORD.findall(t or "")) for i, t, _ in rows}
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    own = {s: sum(size[i] for i, _, x in rows if x == s) for s in sources}
    left, open_, target = 1.5 * sum(own.values()), list(sources), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * own[s]]
        for s in full or open_:
            target[s] = 2.0 * own[s] if full else level * weight[s]
            left -= target[s]
            open_ = [x for x in open_ if x != s]
    taken = {}
    for s in sources:
        mine = [(hashlib.sha256(f"mix-1:{i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], i) for i, t, x in rows if x == s]
        budget = int(target[s] + 1e-6)
        whole, rest = divmod(budget, own[s]) if own[s] else (0, 0)
        for _, i in sorted(mine):
            part = min(size[i], rest)
            taken[i], rest = whole * size[i] + part, rest - part
    return taken


def test_last_stages_by_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    from barloom.llm.common import read, stage

    docs = read(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    mixed = stage(corpus_pipeline.mixed(spark, docs, ""), "t")
    taken = brute_mix(rows)
    wanted = Counter({i: -(-taken[i] // n) if (n := len(WORD.findall(t or ""))) else 1 for i, t, _ in rows})
    assert Counter(r.doc_id for r in mixed.collect()) == +wanted
    plain = Tokenizer.from_file(tokenizer_path())
    text, start = {i: t or "" for i, t, _ in rows}, 0
    for r in sorted(corpus_pipeline.tokens(spark, mixed, "").collect(), key=lambda r: r.start):
        ids = [*plain.encode(text[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
