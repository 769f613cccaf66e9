"""Text operators: exact round trips, brute force, held-out accuracy."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.llm import bpe, langid, mixing, token_orc
from chronofold.llm.htmltree import SiteStyleTree, blocks, main_text, mark
from chronofold.llm.pii import ContextualPII
from chronofold.llm.quality import SiteQuality

BYTE, WORD = bpe.tokenizer_path("byte_bpe_50k.json"), bpe.tokenizer_path("word_bpe_49k.json")
HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n\nb", "a \n b", "x  y", "x y   z", "it's we'll DON'T", "é à́ ñ", "日本 語 テキスト", "\U0001f600 \U0001f601", "a\x1c b\x1f c", "<|endoftext|>", "a <|endoftext|> b<|startoftext|>",
    "tab\tand\r\nlines\n  indented\n", "1234 5.6 + 78", "!!! ??? ...", "﻿bom ​ zero", "A" * 5000, "w " * 5000, "Σίσυφος ΣΑΣ", "ﬁ ligature Å", "\x7f \x00 x",
]


def texts():
    rng = random.Random(2)
    alphabet = "ab é  \n\t.'sS1ß中́ ,<|>"
    return HARD + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(400)]


def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def test_bpe_equals_library():
    own, lib = bpe.ForcedBoundaryBPE(BYTE), library(BYTE)
    for t in texts():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t).tolist() == ids, repr(t)
        assert own.decode(np.array(ids)) == lib.decode(ids, skip_special_tokens=False), repr(t)


def test_words_equal_library():
    own, lib = bpe.ForcedBoundaryBPE(WORD), library(WORD)
    for t in texts():
        assert np.frombuffer(next(token_orc.word_ids(own, [t])), dtype="<u4").tolist() == lib.encode(t or "", add_special_tokens=False).ids, repr(t)


def frame(spark, rows, extra=True):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string")


def test_round_trip(spark):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: r for r in bpe.round_trip(frame(spark, rows), BYTE).collect()}
    lib = library(BYTE)
    for i, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and got[i]["lossless"]
    decoded = bpe.decode_documents(bpe.encode_documents(frame(spark, rows), BYTE), BYTE)
    assert {r["doc_id"]: r["text"] for r in decoded.collect()} == {i: t or "" for i, t in rows}
    assert bpe.round_trip(frame(spark, rows).limit(0), BYTE).count() == 0


def test_orc_files(spark, tmp_path):
    rows = [(i * 7 % 4001, t) for i, t in enumerate(texts())] + [(5, "again"), (5, "again")]
    path = str(tmp_path / "tokens")
    token_orc.write(frame(spark, rows), path, WORD, end_id=2)
    got = token_orc.digests(spark, path).collect()
    lib, at = library(WORD), 0
    assert len(got) == len(rows)
    left = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in left] == sorted(i for i, _ in rows)
    sets = {}
    for i, t in rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        sets.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    for r in left:
        assert r["start"] == at
        sets[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
        at += r["n_tokens"]
    assert {r["doc_id"] for r in token_orc.lookup(spark, path, [7, 14]).collect()} == {7, 14}
    empty = str(tmp_path / "empty")
    token_orc.write(frame(spark, rows).limit(0), empty, WORD, end_id=2)
    assert token_orc.digests(spark, empty).count() == 0


def test_language(spark):
    rng = random.Random(3)
    kinds = {"aa": "abcde", "bb": "vwxyz", "cc": "éèàùç"}
    rows = [(i, " ".join("".join(rng.choices(kinds[k], k=4)) for _ in range(8)), k) for i, k in enumerate(list(kinds) * 60)]
    rows += [(1000, None, "aa"), (1001, "123 !!", "bb"), (1002, "", None), (1003, "abc", None), (None, "abde", "cc"), (1004, "abcd " * 30000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("old"))
    model = langid.fit(docs, ~langid.held_out())
    got = langid.predict(docs, model).withColumn("held_out", langid.held_out()).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got if r["doc_id"] is not None)
    tested = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 1000]
    assert len(tested) > 20 and all(r["lang_pred"] == r["lang"] for r in tested)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004)] == ["und", "und", "und", "aa", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got)
    nothing = langid.fit(docs.limit(0), ~langid.held_out())
    assert langid.predict(docs.limit(3), nothing).first()["lang_pred"] == "und"


PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS:
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for k, c in enumerate(reversed(digits)))
            if {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(digits) <= 19 and total % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_personal_data_equals_patterns(spark):
    rng = random.Random(5)
    alphabet = "a9.@-+ ()1_%é\U0001f600\n"
    rows = [None, "", "x@y", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "999.1.1.1 001.02.3.255", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (988) 555-2485.", "\U0001f600é mail a.b@c.de", "9" * 20000, "a" * 20000, "a@b" + ".c" * 9000, "1 " * 9000, "+" * 500]
    rows += ["".join(rng.choices(alphabet, k=rng.randrange(5, 80))) for _ in range(300)]
    docs = frame(spark, list(enumerate(rows)))
    got = {r["doc_id"]: r for r in ContextualPII().transform(docs).collect()}
    for i, t in enumerate(rows):
        want = plain_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), repr(t)[:200]
        assert set(want) <= set(got[i]["spans"].split(",")) | set(() if want else [""])
    assert ContextualPII().transform(docs.limit(0)).count() == 0


def test_contexts_discover_and_mask(spark):
    rows = [f"my mailbox u{k}@host{k}.example.org today" for k in range(12)] + ["my mailbox someone@intranet today", "no mailbox here", None]
    docs = frame(spark, list(enumerate(rows)))
    got = {r["doc_id"]: r for r in ContextualPII().transform(docs).collect()}
    assert got[12]["n_found"] == 1 and got[12]["n_email"] == 0 and got[12]["spans"] == f"email:{rows[12].index('someone')}:{rows[12].index(' today')}"
    assert sum(r["n_found"] for r in got.values()) == 1
    masked = {r["doc_id"]: r for r in ContextualPII().mask(docs).collect()}
    assert [masked[i]["text"] for i in (0, 12, 13, 14)] == ["my mailbox <EMAIL> today", "my mailbox <EMAIL> today", "no mailbox here", None]
    assert masked[0]["ids"] == "x"


def test_contexts_of_spans_with_blanks(spark):
    rng = random.Random(12)

    def card():
        digits = [4, *(rng.randrange(10) for _ in range(14))]
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits))
        text = "".join(map(str, [*digits, -total % 10]))
        return " ".join(text[k : k + 4] for k in range(0, 16, 4))

    rows = [f"please call +1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} now" for _ in range(60)] + [f"charge {card()} today" for _ in range(60)]
    rows += [f"{rng.choice(['ring', 'try', 'use', 'see'])} +1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)} anytime" for _ in range(60)]
    seeds, found = len(rows), {"call 555-123-4567 now": "phone:5:17", "call (988) 555-2485 now": "phone:5:19", "charge 4111 1111 1111 1112 today": "card:7:26", "call 555 123 4567 or not": "phone:5:17", "fax 555 123 4568 anytime": "phone:4:16"}
    rows += [*found, "in 1999 2000 2001 we met", "page 12 of 30"]
    got = {r["doc_id"]: r for r in ContextualPII().transform(frame(spark, list(enumerate(rows)))).collect()}
    assert all(got[i]["n_found"] == 0 and got[i]["spans"] for i in range(seeds))
    assert {rows[i]: got[i]["spans"] for i in range(seeds, len(rows))} == found | {rows[-2]: "", rows[-1]: ""}


def plain_raking(rows, temper, rounds=8):
    """Chance of each document (doc_id, text, source, lang) by raking in dictionaries."""
    cell_of, tokens, cells = {}, {}, {}
    for r in rows:
        text = r["text"] or ""
        look = [("symbols", r"[#$%&*]{3}"), ("tables", r" \| "), ("capitals", "[A-ZÀ-Þ]{4}"), ("prose", "")]
        cell_of[r["doc_id"]] = (r["source"] or "unknown", r["lang"] or "unknown", next(name for name, p in look if re.search(p, text)))
        tokens[r["doc_id"]] = text.count(" ") + 1 if text else 0
        cells[cell_of[r["doc_id"]]] = cells.get(cell_of[r["doc_id"]], 0) + tokens[r["doc_id"]]
    cells = {c: n for c, n in cells.items() if n}
    weight, total = {c: float(n) for c, n in cells.items()}, sum(cells.values())
    share = lambda of, dim: {v: sum(n for c, n in of.items() if c[dim] == v) for v in {c[dim] for c in of}}
    target = []
    for dim in range(3):
        powers = {v: n**temper for v, n in share(cells, dim).items()}
        target.append({v: p / sum(powers.values()) for v, p in powers.items()})
    for _ in range(rounds):
        for dim in range(3):
            held = share(weight, dim)
            weight = {c: w * target[dim][c[dim]] * total / held[c[dim]] for c, w in weight.items()}
    factor = {c: weight[c] / n for c, n in cells.items()}
    return {i: factor[c] / max(factor.values()) if tokens[i] else 0.0 for i, c in cell_of.items()}


def test_raking_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 30)), rng.choice(["s0"] * 6 + ["s1", "s2", None]), rng.choice(["l0", "l0", "l1"]), "mine") for i in range(600)] + [(900, None, "s0", "l0", "mine"), (901, "", "s1", "l1", "mine")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, tokens string")
    targets = {"source": spark.createDataFrame([("s0", 0.4), ("s1", 0.3), ("s2", 0.2), ("unknown", 0.1)], "value string, share double")}
    got = mixing.Raking(targets=targets, rounds=12).transform(docs).toPandas()
    assert len(got) == len(rows)
    weight = (got["tokens"] * got["factor"]).groupby(got["source"].fillna("unknown")).sum()
    share = (weight / weight.sum()).round(6).to_dict()
    assert share == pytest.approx({"s0": 0.4, "s1": 0.3, "s2": 0.2, "unknown": 0.1}, abs=1e-5)
    assert got["probability"].max() == pytest.approx(1) and not got.loc[got["doc_id"] >= 900, "sampled"].any()
    assert got["sampled"].sum() == pytest.approx(got["probability"].sum(), rel=0.2)
    assert mixing.Raking().transform(docs.limit(0)).count() == 0


def test_quality(spark):
    rng = random.Random(7)
    good = lambda: " ".join("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(60))
    bad = lambda: " ".join("".join(rng.choices("AB#$%", k=5)) for _ in range(60))
    rows = [(i, good() if i % 3 else bad(), f"h{i % 5}", None if i % 7 == 0 else "p", 1 if i % 3 else 0) for i in range(300)] + [(400, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, truth int")
    labels = docs.where("doc_id < 150").select("doc_id", F.col("truth").alias("quality")).unionByName(spark.createDataFrame([(1, None)], "doc_id long, quality int"))
    got = {r["doc_id"]: r for r in SiteQuality().transform(docs, labels).collect()}
    assert np.mean([got[i]["keep"] == bool(t) for i, _, _, _, t in rows if 150 <= i < 300]) >= 0.98
    assert got[400]["host"] == "unknown" and 0 < got[400]["score"] < 1
    plain = SiteQuality().transform(docs, labels.limit(0)).collect()
    assert all(r["keep"] and abs(r["score"] - 0.5) < 1e-9 for r in plain)
    assert SiteQuality().transform(docs.limit(0), labels).count() == 0


PAGE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line {0}</h1><p>First   {0}\n&lt;b&gt; <b>bold</b><br>next<p>Second {0} &nbsp; &#233;</p><div class="share">Share</div>'
    '<div class="promo-x7">Buy {1}</div><p class="read-more">Read our letter</p></article><section id="comments"><p>me too</p></section><aside>Side</aside><form><label>Mail</label></form><footer>&copy; x</footer></body></html>'
)


def test_blocks_of_odd_markup():
    assert main_text(None) == "" and main_text("") == "" and main_text("<p>") == ""
    assert main_text("plain &lt;text") == "plain <text"
    assert main_text("a < b <p>c<!-- x > y --><i>d</i> e<script>z</script></p><p>f</p") == "a < b\ncd e\nf"
    assert main_text("x<p>y") == "x\ny"
    assert main_text('<p title="a > b">t</p>') == "t"
    assert main_text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert [b.text for b in blocks("<article><p><b>x<br><p>y</article>")] == ["x", "y"]
    assert len(main_text("<div>" * 3000 + "deep")) == 4


def test_pages(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(k, k % 2)) for k in range(40)] + [(100, None, None), (101, "http://one.example/", PAGE.format("a", "b")), (102, "bad", "")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r["page_id"]: r for r in SiteStyleTree().transform(pages).collect()}
    for k in range(40):
        assert got[k]["text"] == f"Head & line {k}\nFirst {k} <b> bold next\nSecond {k} é", got[k]["text"]
        assert got[k]["n_chars"] == len(got[k]["text"])
    assert got[100]["text"] == "" and got[102]["n_chars"] == 0
    assert got[101]["text"].startswith("Head & line a\n")
    assert SiteStyleTree().transform(pages.limit(0)).count() == 0


@pytest.mark.parametrize("wrapper", ["class='page has-sidebar'", "class='layout no-sidebar'", "id='wrap' class='header-fixed'", "class='post widget'"])
def test_marked_wrappers_keep_the_page(wrapper):
    body = "A long body of the page with many words. " * 5
    side = "<div class='sidebar'>Side links</div><div class='comments'><div class='comment'>me too</div></div>"
    assert main_text(f"<body><div {wrapper}>{side}<p>{body}</p></div></body>") == body.strip()
    assert main_text(f"<body><div {wrapper}>{side}<article><p>{body}</p></article></div></body>") == body.strip()
    assert main_text(f"<body><p>{body * 4}</p><div {wrapper}><article>{body}</article></div></body>") == f"{body.strip()}\n{body.strip()}".replace(body.strip(), (body * 4).strip(), 1)


def test_articles_that_are_teasers():
    body = "A long body of the page with many words. " * 5
    teasers = "<div class='related'><article>Read this</article><article>And that</article></div>"
    assert main_text(f"<div class='content'><p>{body}</p></div><article>Read this</article>") == f"{body.strip()}\nRead this"
    assert main_text(f"<article><p>{body}</p></article>{teasers}") == body.strip()
    assert main_text("<div class='widget'>a</div><div class='promo'>b</div><div class='ads'>c</div><div class='share'>d</div>") == "a\nb\nc\nd"
    assert len(main_text("<div class=ad>" * 3000 + "deep")) == 4


def test_marked_elements_are_judged_by_importance(spark):
    page = "<body><div class='page has-sidebar'><div class='box'>The same line on every page of the site, and a long one at that</div><p>Text number {0} of page {0}</p></div></body>"
    pages = spark.createDataFrame([(k, f"http://h.example/{k}", page.format(k)) for k in range(30)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in SiteStyleTree().transform(pages).collect()} == {k: f"Text number {k} of page {k}" for k in range(30)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_pipeline(spark):
    """Stages against plain versions on the smallest tables."""
    import corpus_pipeline
    from tests.llm.test_dedup import closure, plain_set

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, sf)
    first = {r["doc_id"]: r for r in kept.collect()}
    assert kept.columns == docs.columns and set(first) == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"])}
    sets = {i: plain_set(r["text"], 5) for i, r in first.items()}
    comp = closure(sets, [(a, b) for a, x in sets.items() for b, y in sets.items() if a < b and x and y and 100 * len(x & y) >= 80 * len(x | y)])
    dedup = corpus_pipeline.near_dedup(spark, kept, sf)
    second = {r["doc_id"]: r for r in dedup.collect()}
    assert dedup.columns == docs.columns and set(second) == {i for i in sets if comp[i] == i}
    masked = {r["doc_id"]: r for r in corpus_pipeline.personal_data(spark, dedup, sf).collect()}
    assert set(masked) == set(second)
    for i, r in masked.items():
        assert not plain_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert plain_spans(second[i]["text"]) or r["text"] == second[i]["text"]
    mixed = corpus_pipeline.mixture(spark, spark.createDataFrame([masked[i] for i in sorted(masked)], docs.schema), sf)
    drawn = {r["doc_id"]: r for r in mixed.collect()}
    chance = plain_raking(list(masked.values()), corpus_pipeline.TEMPER)
    draw = {i: int(hashlib.md5(f"11:{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in masked}
    assert mixed.columns == docs.columns and set(drawn) == {i for i in masked if draw[i] < chance[i]}
    assert all(drawn[i] == masked[i] for i in drawn)
    last = corpus_pipeline.run(spark, sf).collect()
    lib = library(BYTE)
    assert last and {r["doc_id"] for r in last} == set(drawn) and all(r["lossless"] for r in last)
    assert all(list(r["ids"]) == lib.encode(masked[r["doc_id"]]["text"], add_special_tokens=False).ids for r in last)


def test_word_table_equals_the_library():
    import random

    import pyarrow as pa

    path = bpe.tokenizer_path("word_bpe_49k.json")
    library, table, rnd = bpe.load(path).library, token_orc.word_table(path, 2), random.Random(5)
    letters = "abcXYZ019 _ \t\n'\"-.,;:!?()<>|/\\@#$%^&*+=~`[]{}éñßàçüÉİıſ×÷ªº“”’…  　\x1c\x00\x7f\x85日本зд😀éǅʰ½क़"
    words = ["don't", "I'll", "<|endoftext|>", "a" * 30, "é" * 14, "'s", "  ", "\r\n", "_~_", "ç İ!"]
    for _ in range(40):
        texts = [None, "", " ", "x" * 5000]
        for _ in range(100):
            some = rnd.sample(letters, rnd.choice([4, 10, 40]))
            texts.append("".join(rnd.choice(some) if rnd.random() < 0.93 else rnd.choice(words) for _ in range(rnd.choice([3, 8, 30]))))
        sizes, ids = table.encode(pa.array(texts, pa.string()))
        expected = [[*e.ids, 2] for e in library.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]
        assert sizes.tolist() == [len(x) for x in expected]
        assert ids.tolist() == [x for e in expected for x in e]
    assert table.encode(pa.array([], pa.string()))[1].tolist() == []


def test_the_tree_removes_what_no_prior_names(spark):
    """Blocks without any telling name: what the host repeats goes, and only with the tree."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        title, parts = text(5), [text(40) for _ in range(rng.randrange(1, 6))]
        html = f"<body><div class='x1'>Join our club today</div><div class='x2'><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in parts)}<p>Tell your friends</p></div><div class='x3'>Since {1990 + k % 2}</div></body>"
        rows.append((k, f"https://a.example/{k}", html))
        want[k] = "\n".join([title, *parts])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for small in (1_000_000, 0):  # the tree sent to all workers, and fetched by shuffle
        assert {r["page_id"]: r["text"] for r in SiteStyleTree(small=small).transform(pages).collect()} == want
    off = {r["page_id"]: r["text"] for r in SiteStyleTree(tree=False).transform(pages).collect()}
    assert all("Tell your friends" in off[k] and "Join our club" in off[k] for k in want)


@pytest.mark.parametrize("copies", [2, 3, 6, 12])
@pytest.mark.parametrize("inside", ["<article>{}</article>", "<div class='content'>{}</div>", "<main>{}</main>", "<div>{}</div>"])
def test_editions_of_an_article_keep_it(spark, copies, inside):
    """Pages of a host that share an article, beside others: all of it stays, and what the host repeats around it goes."""
    rng = random.Random(copies)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))
    page = "<body><nav><a>Home</a></nav><div class='k1'>Join our club today</div>" + inside + "<div class='k2'>All rights are ours</div></body>"
    shared = [text(30) for _ in range(5)]
    rows, want = [], {}
    for k in range(40):
        parts = [f"Edition {k}", *shared] if k < copies else [text(5), *[text(30) for _ in range(rng.randrange(2, 5))]]
        rows.append((k, f"https://many.example/{k}", page.format("".join(f"<p>{p}</p>" for p in parts))))
        want[k] = "\n".join(parts)
    for k in range(copies):  # a host that has nothing else
        rows.append((100 + k, f"https://few.example/{k}", inside.format("".join(f"<p>{p}</p>" for p in [f"Edition {k}", *shared]))))
        want[100 + k] = "\n".join([f"Edition {k}", *shared])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in SiteStyleTree().transform(pages).collect()} == want


def plain_choice(page, known, threshold=0.25):
    """What main_text keeps, by looking at every block's whole chain again and again; for pages without articles and without main branches that repeat."""
    found = blocks(page)
    total = sum(len(b.text) for b in found)

    def around(b):
        e = b.element
        while e is not None:
            yield e
            e = e.above

    def score(b):
        weight, prior = 0.0, 1.0
        for e in around(b):
            share = sum(len(x.text) for x in found if any(y is e for y in around(x))) / total
            if e.name not in ("", "html", "body") or any(x.startswith("text") for x in e.layout):
                weight = max(weight, known.get(mark("path", e.path), 0.5), share)
            prior *= 1.0 if 0 < e.prior < 1 and share > (0.9 if e.comments else 0.5) else e.prior
        return weight * prior * min(known.get(mark("content", b.element.path), 1.0), known.get(mark("text", b.element.path, b.text), 1.0))

    scores = [score(b) for b in found]
    least = min(threshold, max(scores, default=0))
    return "\n".join(b.text for b, x in zip(found, scores) if x >= least and x > 0)


def test_chosen_texts_equal_a_plain_version(spark):
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(3, 9))) for _ in range(n))
    box = lambda: rng.choice(["<div class='ad'>{}</div>", "<nav>{}</nav>", "<div>{}</div>", "<ul><li>{}</li><li>x</li></ul>", "<div class='comments'>{}</div>", "<section hidden>{}</section>"])
    rows = []
    for k in range(50):
        parts = [box().format(rng.choice(["Join our club", "Tell your friends", text(4)])) for _ in range(rng.randrange(4))]
        parts += [f"<div class='x2'><h1>{text(5)}</h1>{''.join(f'<p>{text(30)}</p>' for _ in range(rng.randrange(1, 4)))}<p>Read on</p></div>"]
        rng.shuffle(parts)
        rows.append((k, f"https://h{k % 2}.example/{k}", f"<body>{''.join(parts)}</body>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    known = {}
    for r in SiteStyleTree().known(pages).collect():
        known.setdefault(r["host"], {})[r["name"]] = r["value"]
    got = {r["page_id"]: r["text"] for r in SiteStyleTree().transform(pages).collect()}
    assert got == {k: plain_choice(h, known[f"h{k % 2}.example"]) for k, _, h in rows}
    assert any("Join our club" in h and "Join our club" not in got[k] for k, _, h in rows)


def test_deep_pages_take_little_memory():
    import tracemalloc

    page = "<div class='a b'><section>" * 50_000 + "deep" + "<p>x" * 1000
    tracemalloc.start()
    try:
        assert main_text(page).startswith("deep\nx")
        assert tracemalloc.get_traced_memory()[1] < 200e6
    finally:
        tracemalloc.stop()


def test_importance_equals_plain_version(spark):
    import math
    from collections import Counter, defaultdict

    from chronofold.llm.htmltree import NEUTRAL, features, host_of

    rows = [(k, f"https://h{k % 3}.example/{k}", f"<body><ul>{'<li>m</li>' * (k % 4)}</ul><p>same</p><div class='c'>text {k % 7}{'<b>x</b>' if k % 5 else ''}</div></body>") for k in range(40)] + [(90, None, None), (91, "https://h1.example/1", None)]
    pages = spark.createDataFrame([*rows, rows[3]], "page_id long, url string, html string")
    tree = SiteStyleTree()
    got = {(r["host"], r["path"]): (r["pages"], r["presentation"], r["content"]) for r in tree.importance(tree._counts(pages)).collect()}
    distinct = {(host_of(u), tuple(features(blocks(h)))) for _, u, h in rows}

    def level(keyed):
        layouts, texts = defaultdict(Counter), defaultdict(Counter)
        for key, is_text, feature in keyed:
            (texts if is_text else layouts)[key][feature] += 1
        out = {}
        for key, counts in layouts.items():
            m = sum(counts.values())
            entropy = -sum(c / m * math.log(c / m) for c in counts.values())
            said = texts[key].values()
            out[key] = m, 1 - math.exp(-entropy), 1 - sum(math.log(c) / math.log(m) for c in said) / len(said) if said and m > 1 else 1.0
        return out

    site = level(((h, p), t, f) for h, got in distinct for p, t, f in got)
    every = level((p, t, f) for _, got in distinct for p, t, f in got)
    assert set(got) == set(site)
    for (host, path), (m, shown, said) in site.items():
        n, all_shown, all_said = every[path]
        toward = lambda m, x, y: (m * x + 10 * y) / (m + 10)
        assert got[host, path] == pytest.approx((m, toward(m, shown, toward(n, all_shown, NEUTRAL)), toward(m, said, toward(n, all_said, 1.0))))


def test_names_that_wrap_articles():
    assert main_text('<body><div class="page no-sidebar"><p>Body text</p></div></body>') == "Body text"
    assert main_text('<div class="with-sidebar"><p>Body text</p></div>') == "Body text"
    assert main_text('<article><p class="legal">A b</p><p class="search-results-para">C d</p></article>') == "A b\nC d"
    assert main_text("<article><header><h1>Title</h1></header><p>x y</p><footer>by me</footer><section class='comments'><p>nice</p></section></article>") == "Title\nx y"


def test_forms_add_spans_that_the_base_pattern_misses(spark):
    """Phones that a following number hides from the base pattern: found by their form, and said so."""
    rng = random.Random(31)
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    rows = [f"{rng.choice(['one', 'two', 'red', 'sun'])} {phone()} {rng.choice(['end', 'fin', 'off'])}" for _ in range(100)]
    hidden = [f"see {phone()} 10.20.{rng.randrange(256)}.7 ok" for _ in range(5)] + [f"see {phone()} 99.99.99.999999 ok" for _ in range(2)]
    docs = frame(spark, list(enumerate([*rows, *hidden, "+1 (23) 4567-8901 99999999 no", None, ""])))
    got = {r["doc_id"]: r for r in ContextualPII().transform(docs).collect()}
    for k, text in enumerate(hidden, len(rows)):
        at = text.index("+")
        assert f"phone:{at}:{at + 17}" in got[k]["spans"].split(",") and got[k]["n_found"] == 1 and got[k]["n_phone"] == 0, text
    assert sum(r["n_found"] for r in got.values()) == len(hidden)


def plain_bootstrap(texts, least=3, trust=0.9, rounds=2, run=4):
    """Spans (text, start, end, by context) that patterns add, in loops; for words with single blanks between and emails only."""
    import re
    from collections import defaultdict

    email, digits = re.compile(r"[a-z0-9.]+@[a-z0-9]+(\.[a-z0-9]+)+"), lambda w: sum(c.isdigit() for c in w)
    found = []  # (text, start, end, word, seed, patterns)
    for k, text in enumerate(texts):
        words = text.split(" ")
        starts = [sum(len(w) + 1 for w in words[:i]) for i in range(len(words))]
        atom, base = [bool(re.search("[0-9@]", w)) for w in words], [bool(email.fullmatch(w)) for w in words]
        plain = lambda i: words[i] if 0 <= i < len(words) and not atom[i] else ""  # noqa: B023, E731
        for i in range(len(words)):
            for n in range(1, run + 1):
                span = range(i, min(i + n, len(words)))
                if len(span) < n or not all(atom[j] for j in span) or (n > 1 and any(base[j] for j in span)):
                    continue
                word, l, r = " ".join(words[j] for j in span), plain(i - 1), plain(i + n)
                ll = plain(i - 2) if l else ""
                patterns = [f"left: {l}"] * bool(l) + [f"two left: {ll} {l}"] * bool(ll) + [f"right: {r}"] * bool(r) + [f"around: {l} {r}"] * bool(l and r)
                patterns.append("form: " + re.sub("[a-z]+", "a", re.sub("[0-9]", "9", word)))
                found.append((k, starts[i], starts[i] + len(word), word, base[i], patterns))
    seeds = [w for *_, w, seed, _ in found if seed]
    low, high = min(map(digits, seeds)), max(map(digits, seeds))
    fits = lambda w: "@" in w and re.search("[a-z]", w) and (low - 3 <= digits(w) <= high + 3 or any(re.search("[a-z]", x) for x in seeds))
    instances = defaultdict(set)
    for *_, word, _, patterns in found:
        for p in patterns:
            instances[p].add(word)
    belief, sure = dict.fromkeys(seeds, 1.0), {}
    for turn in range(rounds):
        sure = {}
        for p, names in instances.items():
            good = sum(belief.get(w, 0) for w in names)
            if good >= least and good / len(names) * (1 - 0.5**good) >= trust:
                sure[p] = good / len(names) * (1 - 0.5**good)
        if turn < rounds - 1:
            doubt, seen = defaultdict(lambda: 1.0), {(p, w) for *_, w, seed, patterns in found if not seed and fits(w) for p in patterns if p in sure}
            for p, w in seen:
                doubt[w] *= 1 - min(sure[p], 0.999)
            belief |= {w: max(belief.get(w, 0), 1 - x) for w, x in doubt.items() if 1 - x >= trust}
    new = sorted((k, a, -b, any(p in sure and not p.startswith("form") for p in patterns)) for k, a, b, w, seed, patterns in found if not seed and fits(w) and any(p in sure for p in patterns))
    out, at = [], (-1, 0)
    for k, a, b, context in new:
        if k > at[0] or a >= at[1]:
            out.append((k, a, -b, context))
            at = k, -b
    return out


def test_contexts_alone_find_what_a_plain_bootstrap_finds(spark):
    """Addresses without a dot are of no form that a seed has; the words around them give some away, over two rounds."""
    rng = random.Random(77)
    word = lambda n=5: "".join(rng.choices("abcdefghij", k=n))
    inner = [f"{word()}{k}@{word()}" for k in range(8)]
    texts = []
    for k in range(240):
        address, noise = f"{word()}{rng.randrange(9)}@{word()}.example", f"{word()}@{word()}{rng.choice(['', '7'])}"
        texts.append(f"{word()} mail {address} today {word()}" if k % 2 else f"{word()} write to {address} {word()}" if k % 4 else rng.choice([f"{word()} {noise} {word()}", f"see {noise} {word()}", f"see {address} {word()}", f"{address} {noise} 12 34 {word()}"]))
    texts += [f"{word()} mail {x} today {word()}" for x in inner] + [f"{word()} box {x} {word()}" for x in inner[:6]] + [f"mail {inner[0]} 12 {word()}", f"write to {word()}@{word()} {word()}"]
    got = ContextualPII().transform(frame(spark, list(enumerate(texts)))).collect()
    want = plain_bootstrap(texts)
    spans = {(r["doc_id"], *map(int, x.split(":")[1:])) for r in got for x in r["spans"].split(",") if x}
    base = sum(r["n_email"] for r in got)
    assert len(spans) == base + len(want) and {x[:3] for x in want} <= spans
    assert sum(r["n_found"] for r in got) == len(want) and sum(r["n_context"] for r in got) == sum(x[3] for x in want)
    assert sum(x[3] for x in want) >= 14 and {k for k, *_ in want} >= {*range(240, 254)}  # those after "box" in the second round only
    assert not {k for k, *_ in plain_bootstrap(texts, rounds=1)} & {*range(248, 254)}


def test_many_identifiers_in_one_text(spark, tmp_path):
    """All identifiers of a text that is full of them are found and masked, in time that is far from quadratic."""
    n = 30_000
    text = " ".join(f"é w{k}@x.example," for k in range(n))
    frame(spark, [(1, text), (2, "mail a@b.cc now")]).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = {r["doc_id"]: r for r in ContextualPII().transform(docs).collect()}
    assert got[1]["n_email"] == n and got[1]["n_found"] == 0
    masked = {r["doc_id"]: r["text"] for r in ContextualPII().mask(docs).collect()}
    assert masked == {1: " ".join(["é <EMAIL>,"] * n), 2: "mail <EMAIL> now"}


def test_mask_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", 7, "m", "t", "s", "r", 5), (1, "mail a@b.cc now", 7, "m", "t", "s", "r", 5), (2, None, None, None, None, None, None, None)], "doc_id long, text string, k1 int, more string, __text string, __spans string, row string, start int")
    got = ContextualPII().mask(docs)
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(str(r).replace("a@b.cc", "<EMAIL>") for r in docs.collect())


def test_language_equals_plain_naive_bayes(spark):
    import math
    from collections import Counter

    rng = random.Random(41)
    rows = [(k, " ".join("".join(rng.choices("abcde" if k % 2 else "defgh", k=4)) for _ in range(6)), "aa" if k % 2 else "bb") for k in range(60)]
    rows += [(100, "ab ab", None), (101, "...", "aa"), (102, "Abc", "aa"), (102, "Abc", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs, ~langid.held_out())).collect()}
    learn = [(t, x) for k, t, x in rows if zlib.crc32(str(k).encode()) % 4 != 2 and x and any(c.isalpha() for c in t)]
    counts, number = {x: Counter() for _, x in learn}, Counter(x for _, x in learn)
    for t, x in learn:
        counts[x].update(langid.grams(t, 1 << 14, 3).tolist())
    for k, t, _ in rows:
        seen = langid.grams(t, 1 << 14, 3).tolist()
        if not seen:
            assert got[k]["lang_pred"] == "und" and got[k]["score"] == 0
            continue
        total = {x: math.log(number[x] / len(learn)) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * (1 << 14))) for g in seen) for x, c in counts.items()}
        top = max(total, key=lambda x: (total[x], x == min(total)))
        assert got[k]["lang_pred"] == top and got[k]["score"] == pytest.approx(1 / sum(math.exp(v - total[top]) for v in total.values()))


def test_cuts_between_letters_equal_the_library():
    encoder = bpe.load(bpe.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(51)
    pools = ["中文文本没有空格的句子例如这个很长的段落需要切分开来处理", "これは日本語のテキストです", "한국어텍스트각", "éèçàüß", "абвгд", "़ािहिन्दी", "abc'srell", "01 .,!", "́"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randrange(1, 90))) for _ in range(1500)] + [pools[0] * 200]
    want = [e.ids for e in encoder.library.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode_many(texts)] == want
    assert len(encoder._pieces(texts[-1])) > 1000
    assert encoder.decode(np.array([10**9, want[0][0]])).startswith("�")
