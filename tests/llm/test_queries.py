"""The registered queries over a written folder: their digest columns against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from marketlake.llm.queries import queries

from test_operators import TEXTS, brute_components, brute_substrings, secrets_of, word_list


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("queries"))
    rows = [(i, t, "en", None if i == 11 else f"s{len(t or '') % 3}", len(t or "")) for i, t in TEXTS]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(len(t or "") > 100), 0) for i, t in TEXTS if i is not None]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def run(spark, folder):
    return lambda name: queries()[name](spark, folder).collect()


def key(doc_id):
    return -1 if doc_id is None else doc_id


RAW = sorted((key(i), (t or "").encode()) for i, t in TEXTS)


def test_op1(run):
    got = sorted((key(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in run("op1_media_columns"))
    want = []
    for i, raw in RAW:
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        want.append((i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:])))
    assert got == sorted(want)
    assert all(r["media_bytes"] > r["payload_bytes"] and len(r["media_sha256"]) == 64 and r["feature"] for r in run("op1_media_columns"))


def test_op2(run):
    got = sorted((key(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in run("op2_secret_scans"))
    want = []
    for i, t in TEXTS:
        spans = secrets_of(t)
        want.append((key(i), *(sum(s.startswith(k) for s in spans.split(",")) for k in ("assign", "access", "hex")), hashlib.sha256(spans.encode()).hexdigest()))
    assert got == sorted(want)
    # All spans: the base ones in their order, and those of the added rule.
    for r in run("op2_secret_scans"):
        spans = r["spans"].split(",") if r["spans"] else []
        base = [x for x in spans if not x.startswith("pem:")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"] and spans == sorted(spans, key=lambda x: int(x.split(":")[1]))


def test_op3(run):
    got = sorted((key(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run("op3_substring_dedup"))
    assert got == sorted((i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in brute_substrings(TEXTS))


def test_op5(run):
    out = run("op5_minhash_near_dedup")
    none = (1 << 63) - 1
    want = sorted((i, n, c if c not in (None, none) else None) for i, n, c in brute_components(TEXTS, 2))
    assert sorted(((key(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in out), key=str) == sorted(want, key=str)


def test_op6(run):
    out = run("op6_source_mixing")
    sizes, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    source = {key(i): (None if i == 11 else f"s{len(t or '') % 3}") for i, t in TEXTS}
    assert sorted((key(r["doc_id"]), r["size"]) for r in out) == sorted((key(i), len(word_list(t))) for i, t in TEXTS)
    for r in out:
        s = source[key(r["doc_id"])]
        sizes[s] += r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        target[s] = r["target"]
        assert r["taken"] <= 2 * r["size"]
    assert all(r["source_size"] == sizes[source[key(r["doc_id"])]] for r in out)
    assert sum(target.values()) == pytest.approx(1.5 * sum(sizes.values())) and all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)


def test_op7(run):
    from tokenizers import Tokenizer

    from marketlake.llm import packing

    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    out = run("op7_retrieval_packing")
    ids = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for _, t in TEXTS]
    assert sorted((key(r["doc_id"]), r["doc_tokens"]) for r in out if r["start"] == 0) == sorted((key(i), len(x)) for (i, _), x in zip(TEXTS, ids))
    known = defaultdict(list)
    for (i, _), x in zip(TEXTS, ids):
        known[key(i)].append(x)
    for r in out:
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for x in known[key(r["doc_id"])])
    rooms = defaultdict(list)
    for r in out:
        rooms[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in rooms.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1].tolist()] and (ends[-1] == 4096 or ends[-1] & (ends[-1] - 1) == 0)


def test_op8(run):
    out = run("op8_sharding")
    assert sorted((key(r["doc_id"]), r["size"], r["text_crc32"]) for r in out) == sorted((i, len(raw) + 1, zlib.crc32(raw)) for i, raw in RAW)
    slots, total = defaultdict(list), sum(r["size"] for r in out)
    weight = defaultdict(int)
    for r in out:
        assert r["law"] == "bytes" and r["grown_shard"] is None
        slots[r["shard"]].append(r["slot"])
        weight[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(abs(w - total / 8) <= max(r["size"] for r in out) for w in weight.values())


def test_op10(run):
    out = run("op10_quality_classifier")
    assert sorted((key(r["doc_id"]), r["held_out"]) for r in out) == sorted((key(i), zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0) for i, _ in TEXTS)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in out)
