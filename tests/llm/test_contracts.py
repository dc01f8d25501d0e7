"""Every registered training-data query over files: names and types of its columns, and its values against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from lumenpage.llm import packing
from lumenpage.llm.queries import QUERIES

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda sigma tau omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(31)
    top = str(tmp_path_factory.mktemp("tables"))
    item = prose(rng, 25)
    docs = [prose(rng, rng.randrange(5, 120)) + (" badword" if i % 7 == 0 else "") for i in range(120)]
    docs += [docs[3], docs[4] + " more", f"x {item} y", 'password = "hunter22" and AKIA' + "Z" * 20, "write é me.you@mail.example.org or +1 (743) 555-3824, 10.0.3.7 4111 1111 1111 1111", "Released under the MIT License.", None, "", " \n", docs[5] * 4, "😀" * 300]
    rows = [(i, t, "en", "s", len(t or ""), None) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, "")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(0, 120, 2)] + [(999, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    vectors = [(i, [rng.uniform(-1, 1) for _ in range(4)], 0) for i in range(250)] + [(300, None, 0), (400, [None] * 4, 0), (500, [float("nan")] * 4, 0)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{top}/embeddings.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", f"turn {t} </s> of {c}") for c in range(5) for t in range(c + 1)] + [(9, 0, None, None)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{top}/conversations.parquet")
    return top, docs


def run(spark, folder, name):
    found = QUERIES[name](spark, folder[0])
    return dict(found.dtypes), {r["doc_id"]: r for r in found.collect()}


def test_op1(spark, folder):
    kinds, rows = run(spark, folder, "op1_toxicity")
    assert kinds == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    assert set(rows) == set(range(len(folder[1])))
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    assert all(rows[i]["predicted"] == int(i % 7 == 0) for i in range(120))


def test_op2(spark, folder):
    found = QUERIES["op2_topk"](spark, folder[0])
    assert dict(found.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"}
    rows = found.collect()
    assert {r["query_id"] for r in rows} == {0, 100, 200} and len(rows) == 30 and not {r["vec_id"] for r in rows} & {300, 400, 500}


def test_op3(spark, folder):
    kinds, rows = run(spark, folder, "op3_secrets")
    assert kinds == {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"}
    patterns = [("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24)]
    for i, text in enumerate(folder[1]):
        want = sorted((m.start(), n, m.end(), k) for n, (k, p, g, least) in enumerate(patterns) for m in re.finditer(p, text or "", re.ASCII) if len(m[g]) >= least)
        assert rows[i]["base_sha256"] == digest([(k, a, z) for a, _, z, k in want])
        assert [rows[i][f"n_{k}"] for k, *_ in patterns] == [sum(w[3] == k for w in want) for k, *_ in patterns]


def test_op4(spark, folder):
    kinds, rows = run(spark, folder, "op4_jaccard")
    assert kinds == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"}
    sets = []
    for t in folder[1]:
        words = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set())
    assert [rows[i]["n_shingles"] for i in range(len(sets))] == [len(s) for s in sets]
    least = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                old, new = max(least[a], least[b]), min(least[a], least[b])
                least = [new if x == old else x for x in least]
    assert [rows[i]["component_id"] for i in range(len(sets))] == least


def test_op5(spark, folder):
    kinds, rows = run(spark, folder, "op5_repeats")
    assert kinds == {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    raw = [(t or "").encode() for t in folder[1]]
    seen = {}
    for t in raw:
        for a in range(len(t) - 199):
            seen[t[a : a + 200]] = seen.get(t[a : a + 200], 0) + 1
    for i, t in enumerate(raw):
        cover = [False] * len(t)
        for a in range(len(t) - 199):
            if seen[t[a : a + 200]] > 1:
                cover[a : a + 200] = [True] * 200
        want = (len(t), sum(cover), sum(c and not p for c, p in zip(cover, [False, *cover])), hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest())
        assert tuple(rows[i])[1:] == want


def test_op6(spark, folder):
    kinds, rows = run(spark, folder, "op6_decontamination")
    assert kinds["contaminated"] == "boolean" and kinds["item_ids"] == "array<bigint>"
    assert [i for i, r in rows.items() if r["contaminated"]] == [122] and rows[122]["item_ids"] == [0] and rows[122]["matched_words"] == 25


def test_op7(spark, folder):
    found = QUERIES["op7_packing"](spark, folder[0])
    assert dict(found.dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = found.toPandas()
    for i, text in enumerate(folder[1]):
        ids = [*packing._defining(packing.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 2]
        own = rows[rows.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and own.piece.tolist() == list(range(len(own)))
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
    placed = rows.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all() and placed.groupby("sequence_id").length.sum().max() <= 1024


def test_op8(spark, folder):
    kinds, rows = run(spark, folder, "op8_pii")
    assert kinds == {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"}
    text = folder[1][124]
    at = lambda part: (text.index(part), text.index(part) + len(part))
    want = [("email", *at("me.you@mail.example.org")), ("phone", *at("+1 (743) 555-3824")), ("ip", *at("10.0.3.7")), ("card", *at("4111 1111 1111 1111"))]
    # the digits of the address, the space and the card make one run, which is no card
    base = [w for w in want if w[0] != "card"] if re.search(r"[0-9]([\x20-]?[0-9])+", text[at("7 4111")[0] :])[0].startswith("7 ") else want
    assert rows[124]["base_sha256"] == digest(base) and set(rows[124]["spans"].split(",")) >= {f"{k}:{a}:{z}" for k, a, z in base}
    assert rows[126]["base_sha256"] == digest([]) and rows[126]["spans"] == ""


def test_op9(spark, folder):
    kinds, rows = run(spark, folder, "op9_licenses")
    assert kinds == {"doc_id": "bigint", "n_templates": "bigint", "licenses": "string"}
    assert {i: r["licenses"] for i, r in rows.items() if r["n_templates"]} == {125: "MIT"}


def test_op10(spark, folder):
    found = QUERIES["op10_chat"](spark, folder[0])
    assert dict(found.dtypes) == {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"}
    rows = {r["conv_id"]: r for r in found.collect()}
    assert set(rows) == {0, 1, 2, 3, 4, 9, -7}
    for c in range(5):
        turns = [("user" if t % 2 == 0 else "assistant", f"turn {t} </s> of {c}") for t in range(c + 1)]
        learnt = "".join(t for r, t in turns if r == "assistant")
        assert rows[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (rows[c]["loss_chars"], rows[c]["loss_sha256"], rows[c]["n_turns"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), c + 1)
    probe = "</s>[INST] ok [/INST]"
    assert rows[-7]["turns_sha256"] == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest() and rows[9]["n_turns"] == 1
