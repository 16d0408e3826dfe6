"""The corpus operators on small tables with nulls, empty and long texts, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillset.llm import exact_dedup, line_dedup, near_dedup, packing, pieces, secrets, sharding, toxicity
from quillset.llm.shared import outside

SCHEMA = "doc_id long, text string, source string, block string, name string, node string, n long, rid long"


def table(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = sources or [None] * len(texts)
    return spark.createDataFrame([(i, t, s, "x", "y", "z", 1, 2) for i, t, s in zip(ids, texts, sources, strict=True)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    words = ["ab", "cd", "ef", "é", "\U0001f600", "x" * 40]
    long = " ".join(rng.choice(words) for _ in range(6000))
    texts = [None, "", " ", "a  b", "a b", "a\tb", "a b ", long, long.replace(" ", "\n"), long + "!", "short", "short", "x" * 5000, "x" * 5001, "x" * 1024, "x" * 2048]
    ids = [*range(9, 9 + len(texts) - 2), 3, None]
    return table(spark, texts + ["short"], [*ids, 3])


def norm(text):
    import re

    return re.sub("[\x20\x09-\x0d]+", " ", text or "")


def test_exact_groups(odd):
    rows = [(r.doc_id, norm(r.text)) for r in odd.collect()]
    got = exact_dedup.exact_duplicates(odd, block_chars=64, hot_share=8).collect()
    size = Counter(t for _, t in rows)
    least = {t: min((i for i, u in rows if u == t and i is not None), default=None) for t in size}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, least[t], size[t], sha(t)) for i, t in rows)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(map(sha, size))
    assert Counter(map(norm, (r.text for r in exact_dedup.without_copies(odd).collect()))) == Counter(dict.fromkeys(size, 1))


def test_exact_many_copies_and_none(spark):
    docs = table(spark, ["same text " * 300] * 200 + [f"other {i} " * 300 for i in range(50)])
    got = exact_dedup.exact_duplicates(docs).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 200} == {(0, 200)} and sum(r.kept for r in got) == 51
    assert exact_dedup.exact_duplicates(docs.filter("false")).count() == 0


def test_lines(spark):
    wide, near, rare = "seen on every site", "seen on four sites", "seen on three sites"
    texts, sources = [], []
    for s in range(12):
        lines = [f"own line {s}", f"  {wide}\t"] + [near] * (s < 4) + [rare] * (s < 3) * 5 + [""]
        texts.append("\n".join(lines))
        sources.append(f"s{s}")
    texts += [None, "", wide, wide]
    sources += [None, None, None, None]
    got = {r.doc_id: r for r in line_dedup.without_boilerplate(table(spark, texts, sources=sources), sites=4).collect()}
    for i, text in enumerate(texts):
        lines = (text or "").split("\n")
        kept = [x for x in lines if x.strip() not in (wide, near)]
        assert got[i].text == "\n".join(kept) and got[i].n_removed == len(lines) - len(kept), i
        assert got[i].n_lines == (len(lines) if text else 0)
    assert line_dedup.without_boilerplate(table(spark, texts).filter("false")).count() == 0


def test_second_half_of_line_keys_is_independent(spark):
    import xxhash

    signed = lambda v: v - 2**64 if v >= 2**63 else v
    for text in ("", "a line", "é" * 50):
        key = spark.range(1).select(line_dedup.key128(F.lit(text)).alias("k")).first().k
        assert key.hi == signed(xxhash.xxh64_intdigest(text.encode(), 42))
        assert key.lo == signed(xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(b"second", 42)))
        assert key.lo != signed(xxhash.xxh64_intdigest(b"second", key.hi % 2**64))


def components_by_force(texts, percent=85):
    def words(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]

    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    shared = " ".join(word() for _ in range(14))
    texts = [None, "", "  ", "one two", "ONE two", "One Two three", "Ä b", "ä b"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(60, 200))]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    centre = [word() for _ in range(300)]  # many copies that resemble the centre, but hardly one another
    texts.append(" ".join(centre))
    for _ in range(60):
        copy = list(centre)
        for at in rng.sample(range(300), 4):
            copy[at] = word()
        texts.append(" ".join(copy))
    texts += [shared + " " + " ".join(word() for _ in range(30)) for _ in range(60)] + [texts[20]] * 40
    sizes, roots = components_by_force(texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(texts))] == [(n, r, r == i) for i, (n, r) in enumerate(zip(sizes, roots, strict=True))]


def test_near_duplicates_at_80_percent(spark):
    import corpus_pipeline

    rng = random.Random(15)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    texts = []
    for k in range(60):  # similarity just above 0.80 or just below: parts of a text, and one with words replaced
        base = [word() for _ in range(204)]
        texts += [" ".join(base), " ".join(base[: 4 + (162 if k % 3 else 158)])]
        other = [word() for _ in range(204)]
        changed = list(other)
        for at in range(10, 10 + 20 * (4 if k % 3 else 6), 20):
            changed[at] = word()
        texts += [" ".join(other), " ".join(changed)]
    sizes, roots = components_by_force(texts, 80)
    docs = table(spark, texts)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, 80).collect()}
    assert 60 < len(set(roots)) < len(texts) and len(set(components_by_force(texts)[1])) > len(set(roots))
    assert [got[i].component_id for i in range(len(texts))] == roots
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(roots)


def test_near_duplicates_with_several_texts_of_one_id(spark):
    words = [f"w{i}" for i in range(200)]
    one, two = " ".join(words), " ".join(w + "x" for w in words)
    one_changed, two_changed = one.replace("w100 ", "other "), two.replace("w50x ", "other ")
    docs = spark.createDataFrame([(4, one), (4, two), (10, two_changed), (11, one_changed), (12, "apart from all"), (4, ""), (20, two_changed)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(4, 4, True), (10, 4, False), (11, 4, False), (12, 12, True), (20, 4, False)}


def test_near_duplicates_without_ids_or_rows(spark):
    docs = table(spark, ["a b c d e f"] * 3, [None, 4, 4])
    assert sorted((r.doc_id or -1, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()) == [(-1, None, True), (4, 4, True), (4, 4, True)]
    assert near_dedup.near_duplicates(docs.filter("false")).count() == 0


def test_best_edges_match_every_choice():
    from itertools import combinations

    rng = random.Random(1)
    for _ in range(60):
        lengths = sorted(rng.sample(range(40), rng.randint(1, 8)))
        bins = [(n, rng.randint(1, 9), 0) for n in lengths]
        bins = [(n, c, n * c) for n, c, _ in bins]
        cost = lambda edges: sum(c * (min(e for e in edges if e >= n) - n) for n, c, _ in bins)
        for k in (1, 2, 3, 20):
            top = min(k, len(lengths))
            best = min(cost([*some, lengths[-1]]) for m in range(top) for some in combinations(lengths[:-1], m))
            edges = packing.best_edges(bins, k)
            assert cost(edges) == best and len(edges) <= k and edges[-1] == lengths[-1]


def test_packing(spark):
    rng = random.Random(2)
    texts = [None, "", " \n"] + ["w " * rng.randint(1, 300) for _ in range(200)] + ["w " * 5000]
    rows = packing.pack_documents(table(spark, texts), buckets=5, budget=1000).collect()
    assert [r.n_tokens for r in sorted(rows, key=lambda r: r.doc_id)] == [len((t or "").split()) for t in texts]
    batches: dict = {}
    for r in rows:
        assert r.padding == r.bucket_edge - r.n_tokens >= 0
        batches.setdefault((r.bucket, r.batch), []).append(r)
    for batch in batches.values():
        assert sorted(r.place for r in batch) == list(range(len(batch)))
        assert len(batch) == 1 or len(batch) * batch[0].bucket_edge <= 1000
    assert packing.pack_documents(table(spark, texts).filter("false")).count() == 0


def test_pieces_equal_the_library(spark):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(4)
    alphabet = ["a", "the", " ", "  ", "▁", "é", "ﬁ", " ", "　", "\n", "\t", "\x00", "\U0001f600", "한", "<s>", "123"]
    texts = [None, "", " ", "▁", "x" * 3000] + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(300)]
    docs = table(spark, texts)
    encoded = pieces.encode_documents(docs)
    ids = {r.doc_id: r.ids for r in encoded.collect()}
    decoded = {r.doc_id: r.text for r in pieces.decode_documents(encoded).collect()}
    digest = {r.doc_id: r for r in pieces.digests(docs).collect()}
    for i, text in enumerate(texts):
        want = model.encode(text or "")
        back = model.decode(want) if want else ""
        assert ids[i] == want and decoded[i] == back, repr(text)
        assert digest[i].n_tokens == len(want) and digest[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()
        assert digest[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_secrets(spark):
    key = "q7Xz0PdK2vRbT9mWc4LsYh8N"
    texts = [
        None, "", "plain prose with nothing", "é PassWord : 'hunter2'", "token=abc", "api_key=abcdef;apikey = \"zzzzzz\"", "AKIA" + "B" * 16 + " AKIA" + "B" * 15,
        "f" * 24 + "g" + "a" * 23, f"see {key} here", "id 123E4567-E89B-12D3-A456-426614174000", "D41D8CD98F00B204E9800998ECF8427E", "internationalisation_of_everything", f"secret={key}",
    ]
    got = {r.doc_id: r for r in secrets.scan_digests(table(spark, texts)).collect()}
    spans = [got[i].spans for i in range(len(texts))]
    assert spans[:5] == ["", "", "", "assign:2:21", ""] and spans[5] == "assign:0:14,assign:15:31" and spans[6] == "access:0:20"
    assert spans[7:] == ["hex:0:24", "random:4:28", "", "", "", "assign:0:31"]
    assert got[6].n_access == 1 and got[5].base_sha256 == hashlib.sha256(spans[5].encode()).hexdigest()
    assert got[8].base_sha256 == hashlib.sha256(b"").hexdigest()
    cleaned = [r.text for r in secrets.redact_documents(table(spark, texts)).orderBy("doc_id").collect()]
    assert cleaned[0] is None and cleaned[8] == "see [SECRET] here" and cleaned[2] == texts[2] and cleaned[12] == "[SECRET]"


def test_secrets_behind_words(spark):
    rng = random.Random(12)
    alphabet = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    around = [("hooks/services/production/", ""), ("users/documents/download/archive/", "/settings"), ("customer-account-notification-service-", "-backup")]
    texts, keys = [], []
    for before, after in around * 20:
        keys.append("".join(rng.choices(alphabet, k=24)))
        texts.append(f"see {before}{keys[-1]}{after} here")
    texts += ["see users/documents/download/archive/settings here", "customer-account-notification-service-backup", "customer/account/notification/service/production/settings/download/of/123E4567-E89B-12D3-A456-426614174000"]
    cleaned = [r.text for r in secrets.redact_documents(table(spark, texts)).orderBy("doc_id").collect()]
    assert not [k for k, t in zip(keys, cleaned, strict=False) if k in t] and cleaned[60:] == texts[60:]
    assert cleaned[1] == "see users/documents/download/archive/[SECRET]/settings here"


def test_shards(spark):
    texts = [None, ""] + ["é" * (i % 97) for i in range(700)]
    docs = table(spark, texts)
    rows = sharding.shard_documents(docs, shards=5, slots=128).collect()
    load = Counter()
    for r in rows:
        load[r.shard] += r["size"]
        assert r["size"] == len((texts[r.doc_id] or "").encode()) + 8
    assert max(load.values()) - min(load.values()) < 0.02 * sum(load.values())
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard_documents(docs.filter("false")).count() == 0


def test_rebalancing_moves_few_slots(spark, tmp_path):
    docs = sharding.slotted(table(spark, ["x" * (i % 211) for i in range(2000)]), 256)
    sizes = sharding.slot_bytes(docs, 256)
    sharding.save_map(sharding.first_map(sizes, 4), str(tmp_path / "map"))
    now = sharding.load_map(spark, str(tmp_path / "map"))
    sharding.save_map(sharding.rebalanced(now, sizes, 5), str(tmp_path / "map"))
    old, new = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, str(tmp_path / "map"), v).collect()} for v in (1, 2))
    moved = [s for s in old if old[s] != new[s]]
    assert len(new) == 256 and set(new.values()) == set(range(5)) and len(moved) < 0.4 * 256
    loads = sizes.join(sharding.load_map(spark, str(tmp_path / "map")), "virtual_slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r.b for r in loads) < 1.06 * min(r.b for r in loads)


def test_toxicity(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("bcdfghjkmnprstuvwxyz", k=6))
    texts, marks = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(20, 200))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "gromblings", "Gromblar"]))
        texts.append(" ".join(words))
        marks.append(int(i % 4 == 0))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)] + [(None, 1), (0, None)], "doc_id long, toxic int")
    docs = table(spark, texts)
    lexicon = toxicity.learn_lexicon(docs, labels)
    assert any(e.startswith(" vii") for e in lexicon.weights) and any(e.startswith(" grombi") for e in lexicon.weights)
    scored = {r.doc_id: r for r in toxicity.score_documents(docs, lexicon).collect()}
    assert sum((scored[i].score >= 0.7) == marks[i] for i in range(900)) >= 890
    more = table(spark, [None, "", "V1L3ST vіlest gr0mblings", "no harm here at all"])
    score = [r.score for r in toxicity.score_documents(more, lexicon).orderBy("doc_id").collect()]
    assert score[:2] == [0.0, 0.0] and score[2] >= 0.7 and score[3] == 0.0
    assert toxicity.learn_lexicon(docs.filter("false"), labels).weights == {}


def test_exception_phrases_cancel():
    lexicon = toxicity.Lexicon({" trash ": 2.0}, (toxicity.fold("trash can")[0],))
    find = lambda t: len(toxicity.matches(t, lexicon.automaton())[0])
    assert (find("the trash can is full"), find("you trash"), find("Tr4sh, trash can")) == (0, 1, 1)


def test_matches_equal_a_naive_matcher():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon({" ab ": 1.0, " abc": 2.0, " ab": 0.5, " ca ": 4.0, " bb ": 8.0}, (" ab ca ", " ca bb ab ", " bb "))
    for _ in range(300):
        text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 4))) for _ in range(rng.randint(0, 40)))
        folded, _ = toxicity.fold(text)
        places = lambda e: [(i, i + len(e)) for i in range(len(folded)) if folded.startswith(e, i)]  # noqa: E731, B023
        covered = [p for e in lexicon.exceptions for p in places(e)]
        longest = {}
        for entry, weight in sorted(lexicon.weights.items(), key=lambda e: len(e[0])):
            # An entry that is an exception too counts as the exception.
            longest |= {} if entry in lexicon.exceptions else {s: (e, weight) for s, e in places(entry)}
        want = sorted((s, w) for s, (e, w) in longest.items() if not any(a <= s and e <= b for a, b in covered))
        assert sorted(toxicity.matches(text, lexicon.automaton())[0]) == want


def test_unseen_characters_and_accents_do_not_hide_words():
    assert {toxicity.fold(t)[0] for t in ("trash", "tr\u200bash", "tr\u00ada\u2060sh", "trásh", "tr\u0430sh", "TRA\u0301SH", "tr4sh")} == {" trash "}
    assert toxicity.fold("각 학교")[0] == " 각 학교 "


def test_spans_inside_others():
    rng = random.Random(6)
    for _ in range(300):
        spans, covers = ([(s, s + rng.randint(1, 9)) for s in (rng.randint(0, 30) for _ in range(rng.randint(0, 9)))] for _ in "ab")
        assert outside(spans, covers) == {(s, e) for s, e in spans if not any(a <= s and e <= b for a, b in covers)}


def test_very_long_texts_of_spans_take_linear_time():
    lexicon = toxicity.Lexicon({" trash ": 2.0}, (toxicity.fold("trash can")[0],))
    start = time.monotonic()
    assert toxicity.matches("trash can " * 100_000 + "trash", lexicon.automaton())[0] == [(1_000_000, 2.0)]
    text = "token=abcdef0123456789abcdef0 " * 100_000
    assert secrets.random_spans(text, secrets.base_spans(text), lambda v: list(v)) == []
    assert time.monotonic() - start < 60


def test_spans_equal_a_naive_scanner(spark):
    """Base spans found character by character; random ones must be runs of key letters of enough length that fail the ratio on their own."""
    rng = random.Random(7)
    key = lambda k: "".join(rng.choices("abcdefghjkmnpqrstuvwxyzABCDEFGHJKMNPQRSTUVWXYZ23456789", k=k))
    words = ["token", "PASSWORD", "api_key", "apikey", '"secret"', ":", "=", " = ", "'", "AKIA", "B" * 17, "deadbeef" * 3, "f" * 23, "x", "/", "-", " ", "the plain words", "é", "\n"]
    texts = ["".join(rng.choice(words) if rng.random() < 0.8 else key(rng.randint(18, 30)) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    encode = secrets._encoder(None)

    def runs(text, letters, start=0):
        i = start
        while i < len(text):
            j = i
            while j < len(text) and text[j] in letters:
                j += 1
            if j > i:
                yield i, j
            i = max(j, i + 1)

    digits, upper = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value_letters = digits + upper + upper.lower() + "+/_.=-"

    def assignment(text, at):
        low = text.lower()
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, at):
                i = at + len(name) + (text[at + len(name) : at + len(name) + 1] in ("'", '"'))
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    return None
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ("'", '"')
                end = next((e for s, e in runs(text, value_letters, i) if s == i), None)
                return end and (end, end - i)
        return None

    def naive(text):
        spans, i = [], 0
        while i < len(text):
            got = assignment(text, i)
            if got and got[1] >= 6:
                spans.append((i, 0, got[0]))
            i = got[0] if got else i + 1
        i = text.find("AKIA")
        while i >= 0:
            j = i + 4
            while j < len(text) and text[j] in digits + upper:
                j += 1
            spans += [(i, 1, j)] if j - i >= 20 and j > i + 4 else []
            i = text.find("AKIA", j if j > i + 4 else i + 1)
        return sorted(spans + [(s, 2, e) for s, e in runs(text, digits + "abcdef") if e - s >= 24])

    for text in texts:
        base = naive(text)
        assert secrets.base_spans(text) == base
        for start, kind, end in secrets.random_spans(text, base, encode):
            value = text[start:end]
            assert kind == 3 and end - start >= secrets.MIN_CHARS and set(value) <= set(value_letters) and len(value) < secrets.RATIO * len(encode(value))
            assert not any(s <= start and end <= e for s, _, e in base)
    got = {r.doc_id: r for r in secrets.scan_digests(table(spark, texts)).collect()}
    for i, text in enumerate(texts):
        by_start = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in naive(text))
        assert got[i].base_sha256 == hashlib.sha256(by_start.encode()).hexdigest()
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == kind for _, k, _ in naive(text)) for kind in range(3)]


def test_toxicity_learns_from_all_but_copies(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("bcdfghjkmnprstuvwxyz", k=5)) for _ in range(60)]  # few words: all texts share most of them
    texts = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(300)]
    near = [t.rsplit(" ", 1)[0] + " changed" for t in texts[:20]]
    marks = [i % 2 for i in range(300)]
    rows = [(i, m, t) for i, (m, t) in enumerate(zip(marks, texts, strict=True))]
    rows += [(1000 + i, marks[i], t) for i, t in enumerate(texts[:30])] + [(2000 + i, marks[i], t) for i, t in enumerate(near)]
    rows += [(3000 + i, 1 - marks[i], t) for i, t in enumerate(texts[:10])]  # the other label: no copy
    sample = spark.createDataFrame(rows, "doc_id long, toxic int, text string")
    kept = {(r.doc_id, r.toxic) for r in toxicity._distinct_contents(sample).collect()}
    assert kept == {(i, m) for i, m in enumerate(marks)} | {(3000 + i, 1 - marks[i]) for i in range(10)}


def test_stages_keep_columns_whose_names_clash(spark):
    import corpus_pipeline

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = {name: F.col("doc_id") * 2 + i for i, name in enumerate(("score", "rate", "n_hits", "n_words", "_of_text", "_sha"))}
    more = docs.withColumns(extra)
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_copies):
        got = stage(spark, more, sf_dir)
        assert got.columns == more.columns
        assert got.filter(" OR ".join(f"`{n}` <> doc_id * 2 + {i}" for i, n in enumerate(extra))).count() == 0
        assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in stage(spark, docs, sf_dir).select("doc_id").collect())


def test_a_stored_map_brings_its_number_of_slots(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id long, text string")
    path = str(tmp_path / "map")
    sharding.save_map(sharding.first_map(sharding.slot_bytes(sharding.slotted(docs, 64), 64), 5), path)
    got = sharding.shard_documents(docs, shards=5, slots=128, map_path=path)
    assert got.count() == 300 and got.agg(F.max("virtual_slot")).first()[0] < 64


def test_texts_reach_python_in_small_batches(spark):
    import pyarrow as pa

    import corpus_pipeline
    from quillset.llm.shared import Scratch
    from quillset.session import ARROW_ROWS, BATCH_ROWS

    sf_dir, before = "/root/testdata/sf0.001", spark.conf.get(ARROW_ROWS)
    most = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches)
    taken = spark.range(0, 3 * BATCH_ROWS, 1, 1).mapInArrow(most, "n long")
    assert Scratch(spark, "test", BATCH_ROWS).store(taken, "taken").agg(F.max("n")).first()[0] == BATCH_ROWS
    assert spark.conf.get(ARROW_ROWS) == before
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    try:
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.mask_secrets):
            spark.conf.set(ARROW_ROWS, 10_000)
            stage(spark, docs, sf_dir)
            assert taken.agg(F.max("n")).first()[0] == BATCH_ROWS
    finally:
        spark.conf.set(ARROW_ROWS, before)


def test_rows_joined_by_node_grow_with_a_near_group_not_its_square(spark, monkeypatch):
    rng = random.Random(21)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    told, store = {}, near_dedup.Scratch.store

    def counted(self, df, name):
        out = store(self, df, name)
        if name.startswith("ends-"):
            told[name] = out.groupBy("whole").count().collect()
        return out

    monkeypatch.setattr(near_dedup.Scratch, "store", counted)

    def joined(n):
        told.clear()
        texts = [" ".join(base[: i % 190] + [f"x{i}"] + base[i % 190 :]) for i in range(n)]
        assert near_dedup.near_duplicates(table(spark, texts)).filter("kept").count() == 1
        return sum(r["count"] for rows in told.values() for r in rows)

    few, many = joined(80), joined(160)
    print("rows joined by node:", few, many)
    assert 0 < few and many <= 3 * few


def test_near_duplicates_take_few_shuffles(spark, monkeypatch):
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base[: i % 190] + [f"x{i}"] + base[i % 190 :]) for i in range(80)]
    monkeypatch.setattr(near_dedup.Scratch, "settle", lambda self, *_: None)
    context, group, held = spark.sparkContext, "few shuffles", "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(held, "true")
    spark.conf.set(held, "false")
    context.setJobGroup(group, group)
    try:
        assert near_dedup.near_duplicates(table(spark, texts)).filter("kept").count() == 1
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set(held, before)
    status = context.statusTracker()
    stages = {s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds}
    full = sum(1 for s in stages if (info := status.getStageInfo(s)) and info.numCompletedTasks >= int(spark.conf.get("spark.sql.shuffle.partitions")))
    print("stages over all shuffle partitions:", full)
    assert full <= 114
