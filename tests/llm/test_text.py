"""The text operators: brute force, exact round trips, held-out accuracy, edge cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import lookalike, mixing, packing, pieces, pii, pii_model, pii_rules, residue, scanned


# --- personal items


def test_crf_gradient_and_partition():
    """The forward pass against all paths of a tiny case, and the gradient against finite differences."""
    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in pii_model.init(4, 3).items()}
    p["T"] = r.standard_normal(p["T"].shape)
    ids, y = r.integers(1, 20, (5, 2)), r.integers(0, len(pii_model.TAGS), (5, 2))
    ids[4, 1] = 0
    loss, grad = pii_model.step(p, ids, y)
    for name in ("T", "Wo", "Whf", "Wxb", "E"):
        at = tuple(r.integers(0, n) for n in p[name].shape)
        for a in [at] if name != "E" else [(int(ids[1, 0]), 1)]:
            eps = 1e-3
            keep = p[name][a]
            p[name][a] = keep + eps
            up = pii_model.step(p, ids, y)[0]
            p[name][a] = keep - eps
            down = pii_model.step(p, ids, y)[0]
            p[name][a] = keep
            assert (up - down) / (2 * eps) * (ids > 0).sum() / ids.shape[1] == pytest.approx(grad[name][a], rel=0.05, abs=2e-3), name


def test_viterbi_in_step_equals_one_by_one():
    r = np.random.default_rng(1)
    p = pii.weights()
    scores = [r.standard_normal((n, len(pii_model.TAGS))).astype(np.float32) * 4 for n in (1, 3, 17, 17, 40, 90)]
    every = pii_model.viterbi(p, scores)
    for s, tags in zip(scores, every):
        assert (pii_model.viterbi(p, [s])[0] == tags).all()


def test_texts_that_are_not_decoded_have_no_spans():
    r, p = np.random.default_rng(3), pii.weights()
    lead = pii_model.margin(p)
    scores = [r.standard_normal((n, len(pii_model.TAGS))).astype(np.float32) * 3 for n in (1, 2, 5, 30, 60)]
    for s in scores:
        s[:, 0] = s[:, 1:].max(1) + lead + 1e-3
    assert all((tags == 0).all() for tags in pii_model.viterbi(p, scores))


def test_windows_cover_whole_texts():
    for n in (1, 127, 128, 129, 500, 10_001):
        w = pii_model.windows(n)
        assert w[0][0] == 0 and w[-1][1] == n and all(b[0] < a[1] for a, b in zip(w, w[1:]))


PII = [
    ("Payment was made to IBAN QM11 ORRB 2849 9366 4998 56 held by Mrs Jorunn Mottetti.", [("account", "QM11 ORRB"), ("name", "Jorunn Mottetti")]),
    ("Write to tamsin.kestling [at] mail [dot] millrace [dot] invalid, quoting 455.1632.10/E.", [("email", "tamsin.kestling")]),
    ("According to Mme Kilnini, the tenant left C/ Olmedal 311, 5º A, 00987 Larkmoor before 14 August 2008.", [("name", "Kilnini"), ("address", "C/ Olmedal")]),
    ("Service was effected on Corwin Bramdal at Am Fennmarkethof 203,\n00729 Ardales.", [("name", "Corwin Bramdal"), ("address", "Am Fennmarkethof")]),
    ("The subscriber of +33 1 99 00 94 02 ext. 510 was never identified, see Case F-755/10.", [("phone", "+33 1")]),
    ("Mr X and Ms A.B. gave evidence in private; the e-mail address is [REDACTED].", []),
    ("The number ending ***-**-1467 was masked by the registry.", []),
    ("Container no. MSKU5970646 left on 11 February 2014; 128 600 kg were landed.", []),
]


def test_items(spark):
    rows = [(i, t) for i, (t, _) in enumerate(PII)] + [(90, None), (91, ""), (92, PII[0][0]), (93, ("x " * 40_000) + PII[0][0])]
    df = spark.createDataFrame(rows, "row_id bigint, text string").withColumn("kind", F.lit("clash"))
    got = {}
    for r in pii.items(df, ["row_id"], "text").collect():
        got.setdefault(r["row_id"], []).append((r["begin_at"], r["kind"]))
    for i, (t, want) in enumerate(PII):
        assert sorted(got.get(i, [])) == sorted((t.index(s), k) for k, s in want), t
    assert got[92] == got[0] and [(b - 80_000, k) for b, k in got[93]] == got[0] and 90 not in got and 91 not in got
    clean = {r["row_id"]: r["clean"] for r in pii.replaced(df.withColumn("clean", F.lit("clash")), "text").collect()}
    assert clean[0] == "Payment was made to IBAN [ACCOUNT] held by Mrs [NAME]." and clean[90] is None and clean[91] == ""
    assert pii.items(df.limit(0), ["row_id"], "text").count() == 0


def test_held_out_accuracy():
    """Texts of unseen names and numbers in the training texts' forms."""
    r, right, want = random.Random(9), 0, 0
    texts = []
    for _ in range(120):
        name = f"{r.choice(['Hedda', 'Corwin', 'Matteo', 'Ulrike', 'Noemie'])} {r.choice(['Bram', 'Tarn', 'Kiln', 'Wex', 'Lorn'])}{r.choice(['stad', 'mere', 'wick', 'etti', 'holt'])}"
        digits = "".join(r.choice("0123456789") for _ in range(7))
        texts.append((f"It was {name} who signed; passport no. XZ{digits}.", [name, f"XZ{digits}"]))
    for (t, items), found in zip(texts, pii.found(pii.weights(), [t for t, _ in texts])):
        got = {t[b:e] for _, b, e in found}
        right, want = right + len(got & set(items)), want + len(items)
    assert right / want >= 0.95


# --- look-alikes


def test_lookalikes(spark):
    same = ["Floor plan and first-floor", "Floor plan and ﬁrst‑ﬂoor", "Ｆｌｏｏｒ plan and first​-floor", "Flооr plаn аnd first-floor", "Floor plan and first-floor"]
    other = ["FLOOR PLAN AND FIRST-FLOOR", "Floorplan and first-floor", "Floor plan and first-floor™", "Floor plan and first-floór", "Floor plan and first-floor 2"]
    rows = [(i, "g", t) for i, t in enumerate(same + other)] + [(50, "g", same[0]), (51, None, same[1]), (52, "g", None), (53, "g", ""), (54, "h", "Noémie"), (55, "h", "Noémie"), (56, "h", "Ｎｏｅ́ｍｉｅ"), (57, "h", "Noemie"), (58, "g", "y" * 50_000)]
    df = spark.createDataFrame(rows, "id bigint, grp string, text string").withColumn("clean", F.lit("clash"))
    forms = lookalike.table_of(df, "text")
    out = lookalike.consistent(df, "text", forms)
    got = {tuple(x) for x in lookalike.same_look(out, "id", ["grp"], "text").collect()}
    ids = [0, 1, 2, 3, 4, 50]
    assert got == {(a, b) for a in ids for b in ids if a < b and (a, b) != (0, 50)} | {(54, 55), (54, 56), (55, 56)}
    clean = {r["id"]: r["clean"] for r in out.collect()}
    assert clean[52] is None and clean[53] == "" and len(clean[58]) == 50_000
    assert lookalike.table_of(df.limit(0), "text") == {}


# --- scanned text


def test_rewriting_ends_without_a_cap():
    assert lookalike.Rewriter({"ﬃ": "ﬀi", "ﬀ": "ff"})("oﬃce") == "office"
    assert lookalike.Rewriter({"ä": "ö", "ö": "ä"})("xä") == "xä"
    chain = {chr(0x400 + i): chr(0x401 + i) for i in range(20)}
    assert lookalike.Rewriter(chain)("Ѐ") == chr(0x400 + 20)


def test_copies_are_not_paired_with_each_other(spark):
    rows = [(i, 1, "ab", "ab") for i in range(3000)] + [(9000, 1, "аb", "ab"), (9001, 2, "ab", "ab")]
    df = spark.createDataFrame(rows, "id bigint, left_id bigint, text string, clean string")
    assert {tuple(r) for r in lookalike.same_look(df, "id", ["left_id"], "text").collect()} == {(i, 9000) for i in range(3000)}


def test_scanned(spark):
    head = "WEXLEY DISTRICT COURT - CV 2023/00000553"
    body = "the respondent maintained that the arrangement was unfair and the learned tribunal agreed with counsel"
    pages = [f"A Ltd v B Ltd\n\n{body}\nthe respondent had the arrangem-", f"{head}\n2\nent and the well-\nfounded claim of the respondcnt\nwas good", f"3\n{head}\nthe arrangement and a well-founded view"]
    fill = "\n".join([body, "a well-founded view of the respondent"] * 20)
    results = spark.createDataFrame([(1, pages), (2, [fill]), (3, [""]), (4, [f"X Co v Y Co\n\n{fill}"])], "row_id bigint, pages array<string>")
    blocks = spark.createDataFrame([(7, "the leamed tri6unal\nagreed with coun‐\nsel"), (8, "\n")], "row_id bigint, text string")
    parts = scanned.repaired_parts(results, blocks)
    assert {tuple(r) for r in parts["furniture"].select("row_id", "line_no", "kind").collect()} == {(1, 5, "running_head"), (1, 6, "page_number"), (1, 10, "page_number"), (1, 11, "running_head")}
    cuts = {(r["src"], r["row_id"], r["line_no"]): r["joined"] for r in parts["cuts"].collect()}
    assert cuts == {("result", 1, 4): "arrangement", ("result", 1, 7): None, ("block", 7, 2): "counsel"}
    assert {(r["src"], r["row_id"], r["line_no"], r["right"]) for r in parts["misread"].collect()} == {("result", 1, 8, "respondent"), ("block", 7, 1, "learned"), ("block", 7, 1, "tribunal")}
    text = {(r["src"], r["row_id"]): r["repaired"] for r in scanned.repaired(results, blocks).collect()}
    assert " ".join(text["result", 1].split()).startswith(f"A Ltd v B Ltd {body} the respondent had the arrangement and the well-founded claim of the respondent was good the arrangement")
    assert text["block", 7] == "the learned tribunal agreed with counsel" and text["block", 8] == "" and ("result", 3) not in text
    empty = scanned.repaired_parts(results.limit(0), blocks.limit(0))
    assert all(f.count() == 0 for f in empty.values())


def test_heads_are_found_by_edit_distance(spark):
    words = "alpha beta gamma delta kappa sigma lambda omega theta zeta".split()
    body = lambda k: "\n".join(f"{words[(3 * k + i) % 10] * (i + 1)} {words[(k + i * i) % 10]} of {words[(7 * k + i) % 10] * (k + 1)} stood there" for i in range(6))
    heads = ["REGISTER OF PLANNING DECISIONS", "REGISTER OF PLANNING DECISIONS", "REGIZTER OF PLANNING DECISIQNS", "LETTERS OF ADMINISTRATION ALTOGETHER"]
    df = spark.createDataFrame([(1, [f"X Ltd v Y Ltd\n\n{body(0)}", *[f"{h}\n{body(k % 5)}" for k, h in enumerate(heads, 1)]])], "row_id bigint, pages array<string>")
    rows = scanned.page_lines(df, ["row_id"], "pages")
    assert [r["line_no"] for r in scanned.furniture(rows, ["row_id"]).where("kind = 'running_head'").orderBy("line_no").collect()] == [9, 16, 23]
    assert {r["line_no"]: r["top"] for r in rows.collect()}[3] == 2


# --- pieces


def test_pieces_round_trip(spark):
    r = random.Random(4)
    texts = ["", "a", "word " * 900, "x" * 5000, "。".join("合同责任" * 30 for _ in range(20))]
    for _ in range(40):
        texts.append("".join(r.choice(["Sentence one. ", "Two v. three! ", "\n", "\n\n", "long" * r.randrange(1, 80), " ", "z" * r.randrange(1, 300)]) for _ in range(r.randrange(1, 120))))
    for t in texts:
        for limit, overlap in ((200, 40), (50, 0), (7, 3), (1800, 200)):
            got = pieces.split(t, limit, overlap)
            assert "".join(t[b + o : e] for b, e, o in got) == t and all(0 < e - b <= limit and 0 <= o <= overlap for b, e, o in got), (limit, t[:50])
            assert all(o > 0 for b, e, o in got[1:]) or not overlap or "\n" in t or " " in t
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "id bigint, text string").withColumn("piece", F.lit("clash"))
    assert pieces.pieces(df, "id", "text", 200, 40).select("id").distinct().count() == len([t for t in texts if t])


def test_splitting_time_grows_with_the_length_only():
    import time

    took = []
    for n in (250_000, 2_000_000):
        text, began = "some words of a text. " * (n // 22), time.process_time()
        assert len(pieces.split(text, 1800, 200)) >= n // 1800
        took.append(time.process_time() - began)
    assert took[1] < 24 * took[0]  # eight times the text


def test_sentences(spark):
    assert [len(x) for x in (pieces.sentence_ends("See Smith v. Jones, No. 5 of para. 3. Next one."), pieces.sentence_ends('He said "no." Then left… Yes?'), pieces.sentence_ends("合同。责任！"), pieces.sentence_ends("line\nline"))] == [2, 3, 2, 2]
    long = "word " * 400
    rows = [(1, f"Short. One.\n\n{long}.\n\n" + "Fine sentence here. " * 200), (2, None), (3, ""), (4, ("a; " * 500) + "v. x " * 200)]
    got = pieces.unsplittable(spark.createDataFrame(rows, "id bigint, t string"), "id", "t").collect()
    assert {tuple(r) for r in got} == {(1, 2), (4, 1)}


# --- packing and mixing


def test_packing(spark):
    r = random.Random(2)
    rows = [(i, r.choice([r.randrange(0, 120), r.randrange(0, 500)])) for i in range(3000)] + [(9001, None), (9002, 350), (None, 5), (9003, 0)]
    df = spark.createDataFrame(rows, "id bigint, n bigint").withColumns({"item": F.lit("clash"), "bin": F.lit(1)})
    got = packing.packed(df, "id", "n", 100, group_items=200).collect()
    fill, parts = {}, {}
    for x in got:
        fill[x["container"]] = fill.get(x["container"], 0) + x["tokens"]
        parts.setdefault(x["id"], []).append(x["tokens"])
    assert max(fill.values()) <= 100 and set(parts) == {a for a, b in rows if a is not None and b is not None}
    assert all(sum(parts[a]) == b and len(parts[a]) == max(1, -(-b // 100)) for a, b in rows if a in parts and b is not None)
    assert len(fill) <= 1.02 * sum(fill.values()) / 100 + 2
    assert packing.packed(df.limit(0), "id", "n", 100).count() == 0


def test_mixing(spark):
    for lengths, counts, budget in (([3, 5, 7], [4, 2, 1], 17), ([4, 6], [3, 3], 11), ([10], [5], 9), ([2, 9, 11], [1, 1, 1], 22)):
        take = mixing.subset(lengths, counts, budget)
        best = max(s for s in {a * lengths[0] + b * (lengths[1] if len(lengths) > 1 else 0) + c * (lengths[2] if len(lengths) > 2 else 0) for a in range(counts[0] + 1) for b in range((counts[1] if len(counts) > 1 else 0) + 1) for c in range((counts[2] if len(counts) > 2 else 0) + 1)} if s <= budget)
        assert sum(a * b for a, b in zip(lengths, take)) == best and all(t <= c for t, c in zip(take, counts))
    r = random.Random(3)
    rows = [(i, s, r.randrange(1, 400)) for i, s in enumerate(["a"] * 2000 + ["b"] * 300 + ["c"] * 50)] + [(9000, None, 5), (9001, "a", None), (9002, "zzz", 9)]
    sizes = spark.createDataFrame(rows, "id bigint, source string, n bigint").withColumn("whole", F.lit("clash"))
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 3)], "source string, target_share double, max_repeats int")
    mix = mixing.mixed(sizes, targets, key="id", source="source", size="n").collect()
    total = sum(x["n"] * x["repeats"] for x in mix)
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4)):
        own = [x for x in mix if x["source"] == s]
        assert abs(sum(x["n"] * x["repeats"] for x in own) / total - share) < 0.001 and max(x["repeats"] for x in own) <= cap
    report = {x["source"]: x for x in mixing.shares(sizes, targets, key="id", source="source", size="n").collect()}
    assert abs(report["a"]["actual_share"] - 0.5) < 0.001 and report["none"]["actual_share"] == 0
    assert mixing.mixed(sizes.limit(0), targets, key="id", source="source", size="n").count() == 0


# --- residue


def test_residue(spark):
    bad = ["HB 1/2\nIN THE MATTER OF {{claimant}}", "Costs of ${amount} are due.", "Please enable JavaScript to read this judgment.", "Error 404: Not Found. Please try again later or contact the administrator of our archive.", "HB 1/2 text. TODO: insert findings of fact.", "Lorem ipsum dolor sit amet consectetur velit.", "Your content here. Your content here.", "[INSERT RESPONDENT]", "Set out here the submissions.", "test test test test test test test test", "«enter decision date»"]
    good = ['The tenancy form contained the printed words "[insert name of tenant]", which the parties struck out.', "The expert explained that the shop required JavaScript and that visitors without it saw a notice.", 'The parties quoted section 9: "{...}" the omitted words.', "Formula {x} in annex B was misapplied.", "[REDACTED] v [party name withheld]", "Pourvoi rejeté.", 'The website\'s only response was a page reading "404 Not Found", which the claimant photographed.', "the Buyer, ________, shall pay", "The respondent expressly denied that the tenant found the covenant.", ""]
    rows = [(i, t) for i, t in enumerate(bad)] + [(100 + i, t) for i, t in enumerate(good)] + [(300, None), (301, "The court held so. " * 9000 + bad[0])]
    df = spark.createDataFrame([(i, t, "HB 1/2", f"s{i % 3}", f"u{i}") for i, t in rows], "id bigint, text string, slug string, host string, unit string").withColumn("lines", F.lit("clash"))
    got = {r["id"] for r in residue.residue(df, "id", "text", slug="slug", host="host", unit="unit").collect()}
    assert got == set(range(len(bad))) | {301}
    assert residue.residue(df.limit(0), "id", "text", slug="slug", host="host", unit="unit").count() == 0


def test_stock_responses_need_detected_company(spark):
    rows = [(i, ("Portal archive home\n" + ("Access denied." if i < 4 else "Nothing to show"))[: 60], f"HB {i}", f"s{i % 2}", f"u{i}") for i in range(6)] + [(i, "Appeal dismissed.", f"HB {i}", f"s{i % 2}", f"u{i}") for i in range(10, 16)]
    df = spark.createDataFrame(rows, "id bigint, text string, slug string, host string, unit string")
    got = {r["id"]: r["evidence"] for r in residue.residue(df, "id", "text", slug="slug", host="host", unit="unit").collect()}
    assert set(got) == set(range(6)) and got[5] == ["stock_response"]
