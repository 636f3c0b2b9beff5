import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from marketloom.llm import langid, mixing, packing, quality, sampling, simhash, suffix, templates, topk, toxicity, warc
from tests.llm.cases import documents, empty
from tests.oracle import check

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").encode())


@pytest.mark.parametrize("module", [mixing, templates, quality, warc, topk], ids=lambda m: m.__name__)
def test_query_matches_its_sql(spark, module):
    for name, sql in module.SQL.items():
        check(spark, module.QUERIES[name], sql)


# 1 mixing


def test_mix_takes_each_source_near_its_target(spark):
    rows, docs = documents(spark)
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        by.setdefault(r["source"], []).append(r)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(words(r[1]))
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    target, free, total = {}, dict(weight), sum(sizes.values())
    while free:  # plain water filling
        level = (total - sum(target.values())) / sum(free.values())
        over = {s for s in free if level * free[s] > 3 * sizes[s]}
        if not over:
            target |= {s: level * free[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        free = {s: w for s, w in free.items() if s not in over}
    for s, own in by.items():
        assert own[0]["source_size"] == sizes[s]
        assert own[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in own) - target[s]) <= 3 * max(r["size"] for r in own)
    again = mixing.mix_plan(docs.repartition(7)).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["copies"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r["copies"] for r in got)


def test_mix_of_nothing_and_of_no_words(spark):
    assert mixing.mix_plan(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (None, "", None)], "doc_id long, text string, source string")
    assert [r["taken"] for r in mixing.mix_plan(blank).collect()] == [0, 0]


# 2 packing


def test_pack_is_whole_gapless_and_tight(spark):
    from tokenizers import Tokenizer

    rows, docs = documents(spark)
    got = packing.pack(docs).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    expected = []
    for r in rows:
        ids = np.array(tok.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for k in range(0, len(ids), 4096):
            own = ids[k : k + 4096]
            expected.append((r[0], k // 4096, k, len(own), zlib.crc32(own.tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1
    assert packing.pack(empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_pack_lengths_places_every_piece_once(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 60) for _ in range(40)}
    bins, total = {}, 0
    for n, rank, first, per, offset in packing.pack_lengths(counts, 100):
        later = [r for m, r, *_ in packing.pack_lengths(counts, 100) if m == n and r > rank]
        for k in range(rank, min(later, default=counts[n])):
            bins.setdefault(first + (k - rank) // per, []).append((offset + (k - rank) % per * n, n))
            total += 1
    assert total == sum(counts.values())
    for own in bins.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 100 and sum(3 * n > 100 for _, n in own) <= 2


def test_words_are_tokenized_as_in_their_text():
    cut = packing.WordTokens(packing.default_tokenizer())
    odd = ["it's <|endoftext|> a_b 12 x² İstanbul ΣΑΣ. é don't, stop!! <|startoftext|>x naïve—yes \t tab\x0bq", "", " ", "ﬁ ﷺ 한글 àb", "x" * 500, "A,B;C é. é, É!"]
    whole = [np.array(e.ids, "<u4").tobytes() for e in cut.tok.encode_batch(odd, add_special_tokens=False)]
    assert cut.texts(pa.array(odd)) == whole and cut.texts(pa.array(odd)) == whole and cut.texts(pa.array([], pa.string())) == []


# 3 WARC


def pages(spark):
    html = ["<p>a</p>", "<p>b</p>", "<p>a</p>", None, "", "WARC/1.1\r\nfake: 1\r\n\r\nx\r\n\r\n", "é" * 70000, "<p>a</p>"]
    rows = [(i + 1, f"http://x/{i} \r\n{i}", h, "clash") for i, h in enumerate(html)] + [(None, None, "<p>a</p>", "c"), (1, "http://x/0", "<p>a</p>", "c")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, payload string")


def test_warc_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path).collect()
    assert len(got) == len(rows) and not any(r["error"] for r in got)
    heads = {}
    for i, _, h, _ in rows:
        if i is not None:
            heads[h or ""] = min(i, heads.get(h or "", i))
    for r in got:
        whole = [h or "" for i, _, h, _ in rows if i == r["page_id"]]
        raw = whole[0].encode()
        assert r["payload_bytes"] == len(raw)
        head = heads[whole[0]]
        revisit = r["page_id"] is not None and r["page_id"] > head
        assert (r["record_type"], r["refers_to"]) == (("revisit", head) if revisit else ("response", None))
        assert r["payload"] == (None if revisit else raw)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_warc_salvages_what_damage_leaves(spark, tmp_path):
    rows, df = pages(spark)
    warc.write_archives(df.where("page_id IN (1, 2, 5, 6)").coalesce(1), f"file://{tmp_path}/w")
    part = next(p for p in (tmp_path / "w").glob("part-*"))
    data = part.read_bytes()
    whole = [r for *_, r in warc.salvage(data)]
    n = len(whole)
    spans = [(a, b) for a, b, _ in warc.salvage(data)]
    a, b = spans[1]
    hurt = data[: a + 40] + b"\0" * 30 + data[a + 70 :]  # second record
    found = list(warc.salvage(hurt))
    assert [r for *_, r in found if r] == [r for k, r in enumerate(whole) if k != 1]
    assert [(x, y) for x, y, r in found if r is None] == [(a, b)]
    members = b"".join(zlib_member(data[x:y]) for x, y in spans)
    assert [r for *_, r in warc.salvage(members)] == whole
    cut = members[:20] + b"garbage" + members[27:]
    assert len([r for *_, r in warc.salvage(cut) if r]) == n - 1
    assert list(warc.salvage(b"")) == [] and [r for *_, r in warc.salvage(b"no record here")] == [None]
    short = data[: spans[-1][1] - 3]
    assert len([r for *_, r in warc.salvage(short) if r]) == n - 1


def zlib_member(data):
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(i: int, body: bytes) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body)
    head = f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Date: {warc.DATE}\r\nContent-Length: {len(http) + len(body)}\r\n\r\n"
    return head.encode() + http + body + warc.RECORD_END


@pytest.mark.parametrize("parsed", [warc.PARSED, 5000])
def test_damaged_members_give_their_whole_records(parsed, monkeypatch):
    monkeypatch.setattr(warc, "PARSED", parsed)
    rng = random.Random(7)
    records = [record(i, rng.randbytes(700)) for i in range(20)]
    member, after = zlib_member(b"".join(records)), zlib_member(record(99, b"after"))
    ids = lambda data: [r["page_id"] if r else None for *_, r in warc.salvage(data)]
    assert ids(member + after) == [*range(20), 99]
    wrong = bytearray(member)
    wrong[-6] ^= 1  # the checksum
    assert ids(bytes(wrong)) == [*range(20), None] and ids(bytes(wrong) + after) == [*range(20), None, 99]
    short = member[:-200]
    assert ids(short) == [*range(19), None] and ids(short + after) == [*range(19), None, 99]
    gap = [(a, b) for a, b, r in warc.salvage(short) if r is None]
    assert len(gap) == 1 and gap[0][1] == len(short) and 0 < gap[0][1] - gap[0][0] < 66_000
    bad_inside = zlib_member(b"".join([*records[:5], b"x" * 50, *records[6:]]))
    assert ids(bad_inside) == [*range(5), None, *range(6, 20)]
    nothing = zlib_member(b"no record at all" * 100)
    assert ids(nothing + after) == [None, 99] and ids(after + nothing) == [99, None]


def test_reading_members_takes_linear_time():
    import time

    def seconds(n):
        data = b"".join(zlib_member(record(i, b"%d" % i * 300)) for i in range(n))
        began = time.process_time()
        assert sum(r is not None for *_, r in warc.salvage(data)) == n
        return time.process_time() - began

    assert seconds(8000) < 8 * seconds(2000)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    rows = [(i, "http://x", "y" * size) for i, size in enumerate([10] * 400 + [3000] * 60 + [200_000] * 9 + [1_500_000])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    warc.write_archives(df, f"file://{tmp_path}/w", min_bytes=1 << 30, file_bytes=500_000)
    sizes = sorted(p.stat().st_size for p in (tmp_path / "w").glob("part-*"))
    assert sizes[-1] < 1_510_000 and sizes[-2] <= 500_000
    got = warc.read_archives(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r["page_id"], len(r["payload"])) for r in got) == sorted((i, len(h)) for i, _, h in rows)


# 4 templates


def test_templates_drop_recurring_lines_but_the_first(spark):
    rows, docs = documents(spark)
    out = templates.drop_template_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped"]
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    assert "Page 0 of" in got[140][0]["text"]
    assert all("printed on day" not in got[140 + i][0]["text"] for i in range(1, 14))
    shared = rows[[r[0] for r in rows].index(120)][1].split("\n")
    line = next(x for x in shared if sum(x in (r[1] or "") for r in rows) >= 14)
    assert line in got[120][0]["text"] and all(line not in got[120 + i][0]["text"].split("\n") for i in range(1, 14))
    assert got[200][0]["text"] is None and got[201][0]["text"] == "" and got[0][0]["text"] == rows[0][1]
    assert templates.drop_template_lines(empty(spark)).count() == 0


def invented(rng, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprstaeiou") for _ in range(7)) for _ in range(n))


def dropped(spark, rows) -> set:
    out = templates.drop_template_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    return {r["doc_id"] for r in out.collect() if r["n_dropped"]}


def test_a_leaf_holds_several_templates(spark):
    rng = random.Random(3)
    rows = [(i, f"This is the message that {invented(rng, 1)} sends to all of us now") for i in range(40)]
    rows += [(100 + i, f"This is the {invented(rng, 1)} who wrote about birds in our old garden") for i in range(15)]
    rows += [(200 + i, f"This is the {invented(rng, 9)}") for i in range(60)]
    assert {len(t.split()) for _, t in rows} == {12}
    assert dropped(spark, rows) == {*range(1, 40), *range(101, 115)}


def test_short_lines_and_rows_of_numbers_are_no_templates(spark):
    rng = random.Random(4)
    rows = [(i, f"It is not {invented(rng, 1)}") for i in range(30)] + [(100 + i, f"{i} {i * 7} {i * i}") for i in range(30)]
    rows += [(200 + i, f"Seen on the {i} page") for i in range(12)] + [(300 + i, "7 1999 2004") for i in range(12)]
    assert dropped(spark, rows) == {*range(201, 212), *range(301, 312)}


def test_lines_of_documents_with_null_or_repeated_ids(spark):
    rng = random.Random(15)
    line = invented(rng, 9)
    rows = [(None, line + "\n" + invented(rng, 20), "c") for _ in range(12)] + [(1, line + "\n" + invented(rng, 20), "c") for _ in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    out = templates.drop_template_lines(docs)
    assert out.where("n_dropped = 1").count() == 23 and out.where("n_dropped = 0").first()["doc_id"] == 1
    plain = templates.drop_template_lines(docs, counts=False)
    assert plain.columns == docs.columns and {r["n_lines"] for r in plain.collect()} == {"c"}
    same = spark.createDataFrame([(1, line)] * 30, "doc_id long, text string")
    assert templates.drop_template_lines(same).where("n_dropped > 0").count() == 0


# 5 toxicity


def test_chain_flags_toxic_words_and_not_others(spark):
    rng = random.Random(1)
    from tests.llm.cases import prose

    rows, labels = [], []
    for i in range(900):
        text = prose(rng, 60)
        if i % 5 == 0:
            text = text.replace(" ", f" {['vile', 'scummy', 'rotten'][i % 3]} ", 2)
        rows.append((i, text, "clash"))
        if i < 700:
            labels.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame([*rows, (None, "vile vile", "c"), (1900, None, "c"), (1901, "", "c")], "doc_id long, text string, _id string")
    labs = spark.createDataFrame([*labels, (5, 1, 1), (None, 1, 1), (3, None, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labs)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.predict(docs, model).collect()}
    wrong = [i for i in range(900) if got[i] != (i % 5 == 0)]
    assert not wrong and got[1900] is False and got[1901] is False
    none = toxicity.train(docs, labs.limit(0))
    assert not any(r["toxic"] for r in toxicity.predict(docs, none).collect())
    assert toxicity.predict(docs.limit(0), model).count() == 0


def test_chain_matches_brute_force(spark):
    """Counts of words, folds and fits anew in plain loops; the fit by many small steps instead of Newton's."""
    rng = random.Random(9)
    stock = ["aaa", "bbb", "ccc", "ddd", "eee", "fff"]
    rows = [(i, " ".join(w for w in stock if rng.random() < 0.5)) for i in range(60)]
    labels = [(i, int(("aaa" in t) == (rng.random() < 0.8)), int(("bbb" in t) == (rng.random() < 0.9))) for i, t in rows[:50]]
    docs, labs = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labs)
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in toxicity.predict(docs, model).collect()}
    sets = [set(t.split()) for _, t in rows]
    used = sorted(w for w in stock if sum(w in s for s in sets[:50]) >= toxicity.MIN_DOCS)
    assert sorted(model.words) == used

    def fit(x, y):
        w = np.zeros(x.shape[1] + 1)
        x = np.hstack([x, np.ones((len(x), 1))])
        penalty = np.array([toxicity.RIDGE] * (x.shape[1] - 1) + [1e-6])
        for _ in range(20_000):
            w -= 0.04 * (x.T @ (1 / (1 + np.exp(-x @ w)) - y) + penalty * w)
        return lambda z: 1 / (1 + np.exp(-(z @ w[:-1] + w[-1])))

    x = np.array([[float(w in s) for w in used] for s in sets])
    known = x[:50]
    low, toxic = (np.array([float(v) for v in c]) for c in zip(*((q == 0, t == 1) for _, q, t in labels), strict=True))
    fold, out = np.array([(i * 2654435761 >> 7) % toxicity.FOLDS for i in range(50)]), np.zeros(50)
    for f in range(toxicity.FOLDS):
        out[fold == f] = fit(known[fold != f], low[fold != f])(known[fold == f])
    first = fit(known, low)(x)
    second = fit(np.hstack([known, out[:, None]]), toxic)(np.hstack([x, first[:, None]]))
    assert np.allclose([got[i] for i in range(60)], np.stack([first, second], axis=1), atol=1e-3)


# 6 quality


def test_base_measures_match_plain_python(spark):
    rows, docs = documents(spark)
    got = {(r["doc_id"], r["n_words"]): r for r in quality.quality_verdicts(docs).collect()}
    for i, text, *_ in rows:
        ws = [w.decode() for w in words(text)]
        win = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
        count = {}
        for w in win:
            count[w] = count.get(w, 0) + 1
        covered = {k + j for k, w in enumerate(win) if count[w] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words(x)]
        r = got[i, len(ws)]
        assert (r["word_chars"], r["n_symbols"]) == (sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"))
        assert (r["n_dup_lines"], r["n_repeat_words"]) == (len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(ws) < 50 or 100 * len(covered) > 50 * len(ws))
        assert not (r["base_failed"] and r["kept"])


def test_lines_over_the_limit_deplete_all_but_the_first(spark):
    rng = random.Random(2)
    from tests.llm.cases import prose

    common = "\n".join(prose(rng, 40, False) for _ in range(2))
    rows = [(i, common + "\n" + prose(rng, 5, False), "h", i) for i in range(8)] + [(50 + i, prose(rng, 80), "h", i) for i in range(5)] + [(90, common + "\nother", "elsewhere", 1), (91, common, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_words int")
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_verdicts(docs, limit=5).collect()}
    assert sorted(i for i, k in kept.items() if not k) == list(range(1, 8))
    out = quality.keep_good(docs, limit=5)
    assert out.columns == docs.columns and out.count() == len(rows) - 7
    assert quality.quality_verdicts(docs.limit(0)).count() == 0


def test_documents_are_counted_by_id_text_and_host(spark):
    rng = random.Random(8)
    from tests.llm.cases import prose

    page = "\n".join(prose(rng, 30, False) for _ in range(3))
    own = [prose(rng, 80) for _ in range(8)]
    rows = [(i, page, "copies") for i in range(8)]  # copies are documents: all but the first go
    rows += [(20, page + "\n" + prose(rng, 3), "one id") for _ in range(8)]  # different texts of one id are documents too
    rows += [(None, page + "\n" + prose(rng, 3), "no id") for _ in range(8)]
    rows += [(40, page, "repeated")] * 8  # one document, stored eight times
    rows += [(50, page, f"h{i}") for i in range(8)]  # one document on each host
    rows += [(60 + i, t, "copies") for i, t in enumerate(own)]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, source string, _host string, h string")
    kept = {}
    for r in quality.quality_verdicts(docs, limit=5).collect():
        kept.setdefault(r["_host"], []).append(r["kept"])
    assert sum(kept["copies"]) == 1 + len(own) and sum(kept["one id"]) == sum(kept["no id"]) == 1 and sum(kept["repeated"]) == 8
    assert all(kept[f"h{i}"] == [True] for i in range(8))
    out = quality.keep_good(docs, limit=5)
    assert out.columns == docs.columns and out.count() == sum(map(sum, kept.values()))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 8, 9, 10, 16, 17, 18, 33, 34, 65_535, 65_538, 400_000])
def test_repeats_at_the_edges_of_position_bits(spark, n):
    words = [f"w{i}" for i in range(n)] + ["a", "b", "c", "a", "b", "c"]
    got = quality.with_repeats(spark.createDataFrame([(words,)], "_words array<string>")).first()["n_repeat_words"]
    assert got == 6 and "_bits" not in quality.with_repeats(spark.createDataFrame([(words[:n],)], "_words array<string>")).columns


# 7 suffix


def brute_suffix(rows, length):
    seen, out = set(), {}
    done = {}
    for i, text in sorted(((r[0], r[1]) for r in rows), key=lambda x: x[0]):
        b = (text or "").encode()
        if (i, b) in done:
            continue
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                cover[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, c in zip(b, cover, strict=True) if not c)
        done[i, b] = (len(b), sum(cover), sum(1 for k, c in enumerate(cover) if c and (k == 0 or not cover[k - 1])), hashlib.sha256(kept).hexdigest(), kept)
        out.setdefault(i, []).append(done[i, b])
    return out


@pytest.mark.parametrize("named", [suffix.NAMED, 3000])
def test_suffix_matches_brute_force(spark, named, monkeypatch):
    monkeypatch.setattr(suffix, "NAMED", named)
    rows, docs = documents(spark)
    expected = brute_suffix(rows, 100)
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) in expected[r["doc_id"]]
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_suffix_on_periodic_and_overlapping_texts(spark):
    rng = random.Random(3)
    unit = "".join(rng.choice("ab") for _ in range(37))
    texts = [unit * 20, "z" * 400, unit * 9 + "q" + unit * 9, "".join(rng.choice("ab") for _ in range(3000)), ("z" * 150 + "y") * 3, "z" * 99, "z" * 100]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "z" * 200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute_suffix([(i if i is not None else 1 << 62, t) for i, t in rows], 100)
    for r in suffix.remove_repeats(docs).collect():
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) in expected[r["doc_id"] if r["doc_id"] is not None else 1 << 62]


@pytest.mark.parametrize("hot", [suffix.HOT, 1])
def test_suffix_of_a_phrase_in_thousands_of_texts(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    phrase, passage = letters(50), letters(160)
    rows = [(i, letters(70) + phrase + letters(70) + (passage if i % 9 == 0 else "")) for i in range(4000)]
    rows += [(4000 + i, rows[i * 7][1]) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keyed = suffix._keyed(docs)
    sent = keyed.mapInArrow(suffix._runs(100, 32, hot), "rank long, context long, doc long, key int, place long")
    assert max(r["count"] for r in sent.groupBy("rank").count().collect()) <= 4 * max(2, hot) + 1
    expected = brute_suffix(rows, 100)
    got = suffix.remove_repeats(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) in expected[r["doc_id"]]


def test_sorted_groups_go_on_over_batches():
    """Batches of any size give what one batch gives."""
    rng = np.random.default_rng(2)
    n = 400
    f = {"rank": rng.integers(0, 9, n), "context": rng.integers(0, 3, n) * (rng.random(n) < 0.4), "doc": rng.integers(0, 30, n), "key": np.zeros(n, "i4"), "place": rng.integers(0, 50, n) << 32}
    f["rank"][:20], f["place"][:10], f["place"][10:20] = np.arange(100, 120), -1 - f["place"][:10], -1 - (f["place"][10:20] | suffix.OPEN)
    f["place"] = np.where(f["place"] >= 0, f["place"] | f["place"] >> 32, f["place"])
    order = np.lexsort((f["place"], f["doc"], f["context"], f["rank"]))
    whole = pa.RecordBatch.from_arrays([pa.array(c[order]) for c in f.values()], list(f))
    rows = lambda step: sorted(tuple(r.values()) for b in suffix._compare(whole.slice(k, step) for k in range(0, n, step)) for r in b.to_pylist())
    assert rows(1) == rows(3) == rows(50) == rows(n)
    strings = pa.RecordBatch.from_arrays([pa.array(c[order].astype("i8")) for c in f.values()], ["rank", "tail", "doc", "check", "place"])
    ones = lambda step: sorted(tuple(r.values()) for b in suffix._repeats(strings.slice(k, step) for k in range(0, n, step)) for r in b.to_pylist())
    assert ones(1) == ones(7) == ones(n)


def test_suffix_of_a_text_of_twenty_megabytes(spark):
    import tracemalloc

    rng = np.random.default_rng(12)
    text = bytes(rng.integers(97, 123, 20_000_000, dtype="u1")).decode()
    text = text[:9_000_000] + text[1_000_000:1_000_700] + text[9_000_000:] + text[1_999_900:2_000_300] + text[:100]
    docs = spark.createDataFrame([(1, text), (2, text[5_000_000:5_000_900])], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix.remove_repeats(docs, keep_text=False).collect()}
    assert got == {1: (20_001_200, 1200, 2), 2: (900, 900, 1)}
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1], pa.int32()), pa.array([text])], ["a", "b", "c"])
    tracemalloc.start()
    sum(len(b) for b in suffix._runs(100, 32)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400_000_000  # it was 49 bytes a byte of text


# 8 language


def plain_sum(word, pieces, prob):
    """Log of the sum over all segmentations, place by place."""
    longest, at = max(map(len, pieces)), np.full((len(word) + 1, prob.shape[1]), -np.inf)
    at[0] = 0.0
    for end in range(1, len(word) + 1):
        for n in range(1, min(longest, end) + 1):
            if (i := pieces.get(word[end - n : end])) is not None:
                at[end] = np.logaddexp(at[end], at[end - n] + np.log(prob[i]))
    return at[-1]


def segmentations(word, pieces):
    return [[]] if not word else [[i, *rest] for p, i in pieces.items() if word.startswith(p) for rest in segmentations(word[len(p) :], pieces)]


TOY = {b"a": 0, b"b": 1, b"ab": 2, b"ba": 3, b"aba": 4, b" ": 5, b" a": 6}


def test_forward_sums_all_segmentations():
    prob = np.array([[0.1, 0.3], [0.2, 0.1], [0.3, 0.2], [0.15, 0.3], [0.25, 0.1], [0.2, 0.1], [0.1, 0.3]])
    ws = [b"a", b"ab", b"abab", b"babaabba", b"b", b"x"]
    tree = langid.as_tree(TOY)
    got = langid.forward(ws, tree, prob)
    assert np.allclose(np.exp(got), [[sum(np.prod(prob[s, k]) for s in segmentations(w, TOY)) for k in range(2)] for w in ws])
    weight = np.arange(1, 2 * len(ws) + 1).reshape(len(ws), 2).astype(float)
    want = np.zeros_like(prob)
    for w, n in zip(ws, weight, strict=True):
        for k in range(2):
            found = [(np.prod(prob[s, k]), s) for s in segmentations(w, TOY)]
            for p, s in found:
                np.add.at(want[:, k], s, n[k] * p / sum(q for q, _ in found))
    assert np.allclose(langid.expected(ws, tree, prob, weight), want) and np.allclose(langid.expected(ws, tree, prob, weight, 3), want)


def test_forward_takes_all_pieces_and_long_words():
    pieces = langid.load_pieces(langid.default_vocabulary())
    assert len(pieces) == 50_256 and max(map(len, pieces)) == 33
    rng, tree = np.random.default_rng(1), langid.as_tree(pieces)
    assert sum(int((ids >= 0).sum()) for _, ids in tree) == 50_256
    prob = rng.random((50_256, 2))
    prob /= prob.sum(axis=0)
    ws = [b" information", " 日本語の文章は区切らずに続きます".encode() * 12, (b"something" * 1200)[:10_000]]
    want = np.array([plain_sum(w, pieces, prob) for w in ws])
    assert np.allclose(langid.forward(ws, tree, prob), want) and np.allclose(langid.forward(ws, tree, prob, 50), want)
    ones = np.ones((3, 2))
    assert np.allclose(langid.expected(ws, tree, prob, ones), langid.expected(ws, tree, prob, ones, 50))


def test_share_of_a_sample_is_right_at_any_size(spark):
    for rows in (0, 1, 1500, 10**6, 1_600_000_000, 3 * 10**9, 10**13):
        assert sampling.share_of(1500, rows) == pytest.approx(min(1.0, 1500 / max(1, rows)))
    ids = spark.range(200_000)
    for share in (0.0, 1e-6, 0.01, 0.5, 1.0):
        n = ids.where(sampling.picked(share, "id", sampling.F.lit("x"))).count()
        assert abs(n - 200_000 * share) <= 5 * (200_000 * share) ** 0.5 and (share < 1 or n == 200_000)
    least = ids.select(sampling.F.shiftrightunsigned(sampling.F.xxhash64("id"), 11).alias("h")).agg({"h": "min"}).first()[0]
    assert 0 < least < (1 << 53) / 10_000  # so shares far below a millionth still tell rows apart


def test_language_matches_brute_force(spark, tmp_path):
    import base64
    from collections import Counter

    vocabulary = tmp_path / "toy.tiktoken"
    vocabulary.write_text("".join(f"{base64.b64encode(p).decode()} {i}\n" for p, i in TOY.items()))
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("ab", [1 + 4 * (i % 2), 3], k=rng.randint(1, 6))) for _ in range(8)), ["x", "y"][i % 2]) for i in range(40)]
    rows += [(7, rows[7][1], "y"), (50, None, "x"), (51, "12", "y"), (52, "abab " * 700, None), (None, "ba", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 4 == 2
    counts = Counter((w, lang) for i, t, lang in rows if t and lang and not held(i) for w in langid.words_of(t))
    prob = np.zeros((len(TOY), 2))
    for turn in range(4):
        new = np.zeros_like(prob)
        for (w, lang), n in counts.items():
            k = "xy".index(lang)
            if not turn:  # every place where a piece stands, by its length
                for p, i in TOY.items():
                    new[i, k] += n * len(p) * sum(w.startswith(p, at) for at in range(len(w)))
                continue
            found = [(np.prod(prob[s, k]), s) for s in segmentations(w, TOY)]
            for q, s in found:
                np.add.at(new[:, k], s, n * q / sum(x for x, _ in found))
        prob = (new + langid.SMOOTH) / (new + langid.SMOOTH).sum(axis=0)
    got = langid.identify(docs, str(vocabulary)).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t, _ in rows:
        texts.setdefault(i, t)
    for r in got:
        t = texts[r["doc_id"]]
        if t is None or t == "12":
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        ll = sum(plain_sum(w, TOY, prob) for w in langid.words_of(t))
        post = np.exp(ll - ll.max()) / np.exp(ll - ll.max()).sum()
        assert r["lang_pred"] == "xy"[int(post.argmax())] and r["score"] == pytest.approx(post.max(), abs=1e-4)


def test_language_on_held_out_documents(spark):
    from tests.oracle import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = [r for r in langid.identify(docs).collect()]
    assert len(got) == len(lang)
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_language_of_odd_texts(spark):
    rows, docs = documents(spark)
    got = {}
    for r in langid.identify(docs).collect():
        got.setdefault(r["doc_id"], []).append(r["lang_pred"])
    assert got[200] == got[201] == got[202] == got[204] == ["und"] and got[203][0] in ("en", "de", "fr") and len(got[7]) == 2
    bare = spark.createDataFrame([(1, "some text", None), (None, "x", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(bare).collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_a_language_of_one_short_document_is_learnt(spark):
    rows = [(i, "the cat sat on the mat and the dog ran to the barn", "en") for i in range(40)] + [(1000 + i, None, None) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train_id = docs.where("doc_id >= 1000").where(~langid.held_out()).first()["doc_id"]
    docs = docs.where("doc_id < 1000").unionByName(spark.createDataFrame([(train_id, "zorvak blimtu quaxen", "xx")], docs.schema))
    langs, prob, pieces = langid.train(docs)
    own = prob[list(pieces.values()), langs.index("xx")]
    assert langs == ["en", "xx"] and own.max() > 5 * own.min()
    assert langid.identify(docs).where(f"doc_id = {train_id}").first()["lang_pred"] == "xx"


# 9 simhash


def brute_fingerprint(text):
    ws = words((text or "").encode().lower().decode())
    sh = [b" ".join(ws[k : k + 4]) for k in range(max(1, len(ws) - 3))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def components(ids, prints, most):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= most:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_simhash_matches_brute_force(spark):
    rows, docs = documents(spark)
    prints = {r[0]: brute_fingerprint(r[1]) for r in rows}
    expected = components(sorted(prints), prints, 4)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}" and r["component_id"] == expected[r["doc_id"]]
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(expected.values()))
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("n", [40, 400])
def test_links_reach_all_within_four_bits(spark, n):
    rng = random.Random(n)
    prints = {}
    for i in range(n):
        v = rng.getrandbits(64) if i % 8 == 0 or not prints else prints[rng.randrange(len(prints))]
        for _ in range(rng.randint(0, 5)):
            v ^= 1 << rng.randrange(64)
        prints[i] = v
    near = rng.getrandbits(64)
    for i in range(n, n + 60):  # one dense bucket
        prints[i] = near ^ 1 << rng.randrange(64) ^ (1 << rng.randrange(64) if i % 2 else 0)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    first = {}
    for i, v in prints.items():
        first.setdefault(v, i)
    distinct = spark.createDataFrame([(signed(v), i) for v, i in first.items()], "fp long, rep long")
    links = simhash.fingerprint_links(distinct).collect()
    assert all(bin(prints[r["a"]] ^ prints[r["b"]]).count("1") <= 4 for r in links)
    root = components(sorted(first.values()), prints, 4)
    got = {i: i for i in first.values()}

    def find(i):
        while got[i] != i:
            i = got[i]
        return i

    for r in links:
        x, y = sorted((find(r["a"]), find(r["b"])))
        got[y] = x
    assert {i: find(i) for i in got} == root


def test_large_buckets_are_dealt_over_blocks(spark):
    rng = random.Random(13)
    base, prints = rng.getrandbits(64), set()
    while len(prints) < 3000:
        v = base
        for _ in range(rng.randint(0, 4)):
            v ^= 1 << rng.randrange(64)
        prints.add(v)
    signed = [v - (1 << 64) if v >> 63 else v for v in [*prints, *(rng.getrandbits(64) for _ in range(200))]]
    distinct = spark.createDataFrame([(v, v) for v in signed], "fp long, rep long")
    links = [simhash.fingerprint_links(distinct, large=n).collect() for n in (100, simhash.LARGE)]
    assert all(bin((r["a"] ^ r["b"]) & (1 << 64) - 1).count("1") <= 4 for r in links[0])
    roots = []
    for own in links:
        root = {v: v for v in signed}

        def find(v, root=root):
            while root[v] != v:
                v = root[v]
            return v

        for r in own:
            x, y = sorted((find(r["a"]), find(r["b"])))
            root[y] = x
        roots.append({v: find(v) for v in signed})
    assert roots[0] == roots[1]


def test_representatives_of_one_id_with_different_texts(spark):
    rng = random.Random(14)
    from tests.llm.cases import prose

    a, b = prose(rng, 80), prose(rng, 80)
    rows = [(5, a, 1), (5, b, 2), (6, a, 3), (7, b, 4), (8, a, 5), (8, a, 6), (None, a, 7), (None, a, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    kept = simhash.keep_representatives(docs)
    assert kept.columns == docs.columns
    first = sorted(tuple(r) for r in kept.collect() if r["doc_id"] is not None)
    assert first == sorted([(5, a, 1), (5, b, 2)]) and kept.where("doc_id IS NULL").count() == 2
    again = simhash.keep_representatives(spark.createDataFrame([(8, a, 5), (8, a, 6), (9, a, 1)], docs.schema).repartition(3)).collect()
    assert len(again) == 1 and again == simhash.keep_representatives(spark.createDataFrame([(8, a, 6), (8, a, 5)], docs.schema)).collect()


def test_golay_code_decodes_three_errors():
    error, single = simhash.golay()
    assert len(set(error.tolist())) == 2048 and max(bin(e).count("1") for e in error.tolist()) == 3


# 10 top-k


def test_topk_with_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(400, 8)).astype("float32")
    m[100:160] = m[0]
    rows = [(i, m[i].tolist(), "c") for i in range(400)] + [(400, None, "c"), (401, [1.0] * 7 + [None], "c"), (402, [float("nan")] * 8, "c"), (403, [float("inf")] * 8, "c"), (None, [1.0] * 8, "c"), (404, [1.0], "c"), (3, m[3].tolist(), "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf string")
    got = topk.top_k(df).collect()
    v = {i: np.floor(256 * np.asarray(e, "f8")).astype("i8") for i, e, _ in rows[:400]}
    for q in range(0, 400, 50):
        every = sorted(((-int(v[q] @ x), i) for i, x in v.items() if i != q), key=lambda x: x) + ([(-int(v[q] @ v[3]), 3)] if q != 3 else [])
        best = sorted(every)[:5]
        assert [(r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == [(i, -s) for s, i in best]
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id IN (0, 1)")).collect()[0]["vec_id"] == 1


@pytest.mark.parametrize("seed", range(4))
def test_pruning_never_loses_a_neighbour(seed):
    rng = np.random.default_rng(seed)
    points = np.floor(256 * (rng.normal(size=(600, 4)) * 0.1 + rng.normal(size=(6, 4))[rng.integers(0, 6, 600)]))
    root, centers = topk.build_tree(points, 24)
    leaf = ((points[:, None] - centers[None]) ** 2).sum(axis=2).argmin(axis=1)
    gap = np.sqrt(((points - centers[leaf]) ** 2).sum(axis=1))
    score = points @ points.T
    np.fill_diagonal(score, -np.inf)
    kth = np.sort(score, axis=1)[:, -5]
    stats = {k: {"radius": gap[leaf == k].max(initial=0), "rows": int((leaf == k).sum()), "query_radius": gap[leaf == k].max(initial=0), "queries": int((leaf == k).sum()), "worst": kth[leaf == k].min(initial=np.inf)} for k in range(len(centers))}
    topk.cover(root, stats)
    pairs = []
    topk.pairs_left(root, root, pairs)
    left = set(pairs)
    assert len(left) < len(centers) ** 2
    for q in range(600):
        for d in np.argsort(-score[q])[:5]:
            assert (leaf[q], leaf[d]) in left


def test_work_grows_less_than_the_table_on_clusters(spark):
    """Vectors in clusters whose number grows with the table: a query's products stay near the size of its cluster."""
    done = []
    for n in (4000, 16000):
        rng = np.random.default_rng(5)
        centre = rng.normal(size=(n // 100, 16))
        m = centre[np.arange(n) % len(centre)] + rng.normal(size=(n, 16)) * 0.02
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
        worked: list[int] = []
        got = topk.top_k(df, leaf_rows=100, worked=worked).collect()
        v = np.floor(256 * m)
        for q in range(0, n, 400):
            score = v @ v[q]
            score[q] = -np.inf
            best = sorted(range(n), key=lambda i: (-score[i], i))[:5]
            assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == best
        done.append(sum(worked) / (n / 50))
    assert done[1] < 2 * done[0] and done[1] < 16000 / 4


def test_null_and_large_ids_keep_their_rows(spark):
    rows, docs = documents(spark, plain=12)
    big = (1 << 60) + 1
    extra = spark.createDataFrame([(None, rows[2][1], "en", "s0", 1), (None, None, None, None, None), (big, rows[4][1], "en", "s0", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    df = docs.unionByName(extra, allowMissingColumns=True).coalesce(1)
    labels = spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)], "doc_id long, quality int, toxic int")
    n = len(rows) + 3
    results = [
        mixing.mix_plan(df), packing.pack(df).where("piece = 0"), templates.drop_template_lines(df), toxicity.predict(df, toxicity.train(df, labels)),
        quality.quality_verdicts(df), suffix.remove_repeats(df), langid.identify(df), simhash.near_duplicates(df),
    ]
    for got in results:
        ids = [r["doc_id"] for r in got.select("doc_id").collect()]
        assert len(ids) == n and ids.count(None) == 2 and ids.count(big) == 1
    assert mixing.mix(df).columns == df.columns and quality.keep_good(df).count() > 0
    assert simhash.keep_representatives(df).where("doc_id IS NULL").count() == 2
