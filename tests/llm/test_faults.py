import base64
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from sensorweave.llm import decontaminate, quality, secrets, warc

DOCS = "doc_id long, text string, _words string, _lines string, spans string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, None, "clash", None) for i, t in enumerate(texts)], DOCS)


def test_what_a_base_span_leaves_of_a_random_string(spark):
    left, right = "Zq8Kx0PvLw3TfBmY", "GjQvZpXr7LwTfB2mYcH"
    text = left + "0a1b2c3d4e5f60718293a4b5" + right
    row = secrets.scan(docs(spark, [text, "my_secret=" + "a" * 30 + " and internal-token: abcdefgh"])).collect()
    assert row[0].spans == "random:0:16,hex:16:40,random:40:59" and row[0].clean_text.strip("[SECRET]") == ""
    assert row[1].n_random == 0 and row[1].n_assign == 2


def test_base_spans_against_plain_patterns(spark):
    """Every pattern as the contract writes it, letter by letter over random texts of its own alphabet."""
    rng = random.Random(8)
    bits = ["password", "SECRET", "token", "Api_Key", "apikey", "=", ": ", "'", "AKIA", "AB12", "0f", "abcdef", "9", " ", "é", "-", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(5, 90))) for _ in range(300)]
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for r in secrets.scan(docs(spark, texts)).collect():
        t, want = texts[r.doc_id], []
        want += [(m.start(), 0, m.end(), "assign") for m in re.finditer(assign, t, re.I | re.A) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert r.base_spans == ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(want))


def planted(rng):
    """Random keys of several alphabets and lengths, and harmless strings of the same lengths."""
    alphabets = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
                 "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    keys = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (20, 24, 32, 40, 64) for _ in range(20)]
    words = "internal user account service request handler release document version parser network session manager update".split()
    plain = []
    for _ in range(200):
        some = [rng.choice(words) for _ in range(rng.randrange(3, 6))]
        plain.append(rng.choice(["-".join(some), "_".join(some), "/".join(some), "".join(w.title() for w in some), " ".join(some)]))
    plain += [hashlib.sha1(str(i).encode()).hexdigest().upper() for i in range(20)]
    return keys, plain


def test_recall_and_false_alarms_of_random_strings(spark):
    keys, plain = planted(random.Random(4))
    got = {r.doc_id: r.n_random for r in secrets.scan(docs(spark, [f"see {x} here" for x in keys + plain])).collect()}
    found = sum(got[i] > 0 for i in range(len(keys)))
    alarms = sum(got[len(keys) + i] > 0 for i in range(len(plain)))
    assert found >= 0.97 * len(keys) and alarms <= 0.01 * len(plain), (found, alarms)


def leaks_by_hand(text, items, size=8, share=0.5):
    """Items whose windows of lower-case words cover half of them, over all alignments at once; exact copies only."""
    w = re.findall(r"[a-z]+", text.lower())
    grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    out = set()
    for k, item in items.items():
        v = re.findall(r"[a-z]+", item.lower())
        hit = {j for i in range(len(v) - size + 1) if tuple(v[i:i + size]) in grams for j in range(i, i + size)}
        if len(hit) >= share * len(v):
            out.add(k)
    return out


def test_decontamination_against_all_windows(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    items = {i: " ".join(word() for _ in range(rng.randrange(15, 50))) for i in range(12)}
    texts = []
    for i in range(80):
        w = [word() for _ in range(60)]
        item = items[rng.randrange(12)].split()
        at = rng.randrange(len(item) // 2)
        w[20:20] = item[at:at + rng.randrange(6, len(item))]
        texts.append(" ".join(w))
    table = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs(spark, texts), table).collect()}
    assert got == {(i, k) for i, t in enumerate(texts) for k in leaks_by_hand(t, items)} and 20 < len(got) < 80


def test_equal_key_names_are_refused(spark):
    table = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    with pytest.raises(ValueError):
        decontaminate.matches(docs(spark, ["x"]), table, item="doc_id")


def test_a_slower_rule_moves_back(spark):
    texts = [" ".join(f"w{i}x{j}#" if (i + j) % 3 else "word" for j in range(300)) for i in range(200)]
    based = quality.base_columns(docs(spark, texts))
    n = lambda: 10 * quality.count_of(F.col("text"), "#") > F.col("n_words")
    slow = n()
    for c in "abcdefghi":  # ten passes over the text in place of one
        slow = slow & (quality.count_of(F.col("text"), c) >= 0)
    rules = [quality.Rule("slow", slow), quality.Rule("fast", n()), quality.Rule("cheap", F.col("n_words") < 0)]
    for _ in range(3):
        stats = quality.estimate(based, rules)
        assert [r.name for r in quality.ordered(rules, stats)] == ["fast", "slow", "cheap"], stats


def test_quality_keeps_columns_of_any_name(spark):
    out = quality.judge(docs(spark, ["a b c", None]))
    assert {"_words", "_lines", "spans"} <= set(out.columns) and {r._lines for r in out.collect()} == {"clash"}
    assert quality.keep_good(docs(spark, ["x"])).columns == ["doc_id", "text", "_words", "_lines", "spans"]


def test_records_are_rebuilt_byte_for_byte(spark):
    rows = [(1, "http://a/é\r\nx", "same", "k"), (2, "u2", "same", None), (3, None, None, "r"), (4, "u", "x\r\n\r\ny" * 300_000, "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record string")
    got = {r.page_id: r for r in warc.digest_columns(warc.round_trip(df)).collect()}
    for k, url, html, _ in rows:
        body = (html or "").encode()
        name = base64.b32encode(hashlib.sha1(body).digest()).decode()
        kind = "revisit" if k == 1 else "response"
        lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{k}>",
                 "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha1:{name}"]
        if k == 1:
            lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To: <urn:page:2>"]
        kept = b"" if k == 1 else body
        lines += ["Content-Type: text/html", f"Content-Length: {len(kept)}"]
        whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + kept + b"\r\n\r\n"
        assert (got[k].payload_bytes, got[k].payload_digest, got[k].record_type) == (len(body), name, kind)
        assert got[k].record_sha256 == hashlib.sha256(whole).hexdigest() and got[k].refers_to == (2 if k == 1 else None)
    assert warc.digest_columns(warc.round_trip(df.limit(0))).count() == 0


def test_a_damaged_record_fails(spark):
    df = spark.createDataFrame([(1, "u", "some text")], "page_id long, url string, html string")
    records = warc.round_trip(df)
    torn = records.withColumn("record", F.concat(F.expr("substring(record, 1, octet_length(record) - 6)"), F.lit(b"\r\n\r\n")))
    with pytest.raises(Exception, match="damaged record"):
        warc.digest_columns(torn).collect()
