"""The training-data operators against brute force, exact round trips and odd inputs."""

import hashlib
import io
import itertools
import random
import re
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sitebrief.llm import chat, licenses, media, minhash, mixing, pieces, quality, secret_scan, suffixes, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over a lazy dog near the river bank while old friends talk about summer plans and rain"


def prose(rnd, n):
    words = PROSE.split()
    return " ".join(rnd.choice(words) + rnd.choice(["", "", "s", "ed", "x"]) for _ in range(n)) + "."


def odd_texts():
    """Null, empty, blank, very long, tied and control texts."""
    rnd = random.Random(5)
    long = prose(rnd, 30_000)
    return [None, "", " \n\t ", "a", "é\U0001F600 x", long, long, "aaaa " * 300, "x" * 5000, "<|im_end|>\n\\", "password = \"\""]


def documents(spark, texts):
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    """The same table with more columns, whose names the operators use themselves."""
    extra = {n: F.lit(1) for n in ("key", "size", "rank", "id", "h", "words", "uid", "raw", "place", "bucket", "kept",
                                   "n_words", "score", "component_id", "_row", "_text", "copies", "cut", "target")}
    return df.withColumns(extra)


# --- chat ---------------------------------------------------------------------------------------------------------

def test_templates_are_folded_and_sandboxed():
    tree = chat.fold(chat.parse("{% if 'a' == 'a' %}{{ 'x' ~ 1 }}y{% else %}z{% endif %}{# note #}"))
    assert tree == [("emit", ("const", "x1y"))]
    render = chat.compile_template(
        "{% set sep = '|' %}{% for m in messages %}{{ m.role | upper }}{% if not loop.last %}{{ sep }}{% endif %}{% endfor %}")
    assert "".join(t for t, _ in render(iter([{"role": "a"}, {"role": "b"}]))) == "A|B"
    assert "".join(t for t, _ in chat.compile_template("{{ messages.__class__ }}{{ x['y'] }}")([], x={"y": 2})) == "2"
    for bad in ("{% for x %}{% endfor %}", "{% if a %}", "{{ a | shell }}", "{% import os %}", "{{ (a }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_escapes_round_trip():
    for text in ("", "\\", "<|", "\\<|n", "a\\nb", "<|im_end|>\n", "<\\|", "\n"):
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape_name(text)) == text and "\n" not in chat.escape_name(text)


def test_conversations(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n<|im_start|>x"), (1, 1, "assistant", None), (2, None, None, "b"),
            (2, 0, "a\nb", "\\"), (None, 0, "assistant", "z"), (3, 0, "assistant", "w" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit(9))
    got = {r["conv_id"]: r for r in chat.format_digests(df).collect()}
    whole = {r["conv_id"]: r for r in chat.format_conversations(df).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        text = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv]["formatted_chars"] == len(whole[conv]["formatted"])
        spans = "".join(whole[conv]["formatted"][s["start"]:s["end"]] for s in whole[conv]["learnt"])
        assert chat.unescape(spans) == loss
    assert chat.format_digests(df.limit(0)).count() == 0


# --- media --------------------------------------------------------------------------------------------------------

def test_media_round_trip(spark):
    texts = odd_texts()
    df = clashing(documents(spark, texts)).unionByName(clashing(documents(spark, texts)).limit(1))
    got = media.media_digests(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["media_sha256"] == hashlib.sha256(media.to_png(payload)).hexdigest()
    assert media.media_digests(df.limit(0)).count() == 0


def test_ranges_share_the_members(spark, tmp_path):
    df = documents(spark, [prose(random.Random(i), 200) for i in range(50)])
    assert media.write_archives(df.repartition(3), str(tmp_path), archive_bytes=4000) == 50
    got = media.media_columns(spark, str(tmp_path), rangebytes="1500", batchbytes="500")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(50))


def test_a_member_is_read_again():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("0_1_2.png", b"abc")
        z.writestr("1_2_2.png", b"def")
    good, opened = buffer.getvalue(), []
    member = zipfile.ZipFile(io.BytesIO(good)).infolist()[1]

    def flaky():
        opened.append(1)
        return io.BytesIO(good.replace(b"def", b"dxf") if len(opened) < 3 else good)

    assert media.read_member(flaky, member, 4, 0) == b"def" and len(opened) == 3
    with pytest.raises(OSError):
        media.read_member(lambda: io.BytesIO(good[:member.header_offset]), member, 2, 0)


# --- quality ------------------------------------------------------------------------------------------------------

def brute_quality(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    counts = Counter(grams)
    inside = {j for i, g in enumerate(grams) if counts[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(inside) > 50 * len(words)
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in quality.SYMBOLS), len(lines) - len(set(lines)), len(inside), failed)


def test_quality_figures(spark):
    rnd = random.Random(2)
    texts = odd_texts() + ["a b c a b c a b c", "a\na\n\na", "#*$%&|<> x", "\n".join(prose(rnd, 12) for _ in range(20))]
    got = {r["doc_id"]: r for r in quality.quality_table(clashing(documents(spark, texts))).collect()}
    for i, text in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_quality(text), i


def test_quality_verdicts(spark):
    rnd = random.Random(3)
    good = "\n".join(prose(rnd, 25) for _ in range(8))
    menu = "\n".join("Home | News | About | Contact" for _ in range(30)) + "\n" + prose(rnd, 60)
    marks = " ".join(w + "###" for w in prose(rnd, 100).split())
    some = good + "\nAll rights reserved.\nHome | About"
    df = documents(spark, [good, menu, marks, some, None])
    kept = {r["doc_id"] for r in quality.keep_good(df).collect()}
    assert kept == {0, 3} and quality.keep_good(df).columns == df.columns
    assert quality.keep_good(df.limit(0)).count() == 0
    plan = quality.keep_good(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- secrets ------------------------------------------------------------------------------------------------------

def test_guess_cost():
    cost = secret_scan.GuessCost()
    weak = ["password1", "P@ssw0rd2021", "changeme123", "aaaaaaaaaaaa", "qwertyuiop", "20210131", "abcdefgh", "your_api_key_here"]
    strong = ["xK9#mQ2$vL7p", "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"]
    assert max(map(cost, weak)) < 40 < min(map(cost, strong)) and cost("") == 0
    # The least over all cuts: cutting anywhere costs no less than the whole.
    for v in weak + strong:
        assert all(cost(v) <= cost(v[:i]) + cost(v[i:]) + 1e-9 for i in range(len(v)))
    assert cost("ab" * 50_000) < 40  # linear in the value


def test_secret_spans(spark):
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'é token = "{key}" x', "AKIA" + "B" * 14, "AKIA" + "B" * 13, "api_key:" + "z" * 11, 'passphrase: "xK9#mQ2$vL7p!"',
             "password is summer", "deadbeef" * 2, None]
    df = clashing(documents(spark, texts + odd_texts()))
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(df).collect()}
    assert len(got) == len(texts) + len(odd_texts())
    assert [tuple(got[i])[1:4] for i in range(8)] == [(1, 0, 1), (0, 1, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert got[0]["spans"] == f"assign:2:{11 + len(key)},hex:11:{11 + len(key)}"
    assert got[4]["spans"] == "guess:13:25" and got[5]["spans"] == ""
    clean = {r["doc_id"]: r for r in secret_scan.redact(documents(spark, texts)).collect()}
    assert clean[0]["text"] == 'é [secret]" x' and clean[0]["n_chars"] == len(clean[0]["text"])
    assert clean[7]["text"] is None and clean[5]["text"] == texts[5]


def test_values_go_whole(spark):
    tail = "#7Wb!q9Zr2$Vn"
    key = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2"
    texts = [f'password = "kT9vQ2mZ4pLx{tail}" x', f"token={key}, x", f"token:{key}{tail}", "password = changeme-default#"]
    got = {r["doc_id"]: r for r in secret_scan.scan_secrets(documents(spark, texts)).collect()}
    assert [got[i]["n_guess"] for i in range(4)] == [1, 0, 1, 0] and [got[i]["n_assign"] for i in range(4)] == [1] * 4
    assert got[0]["spans"] == "assign:0:24,guess:12:37"
    clean = {r["doc_id"]: r["text"] for r in secret_scan.redact(documents(spark, texts)).collect()}
    assert [clean[i] for i in range(4)] == ['[secret]" x', "[secret], x", "[secret]", "[secret]#"]


def test_each_name_has_its_own_value():
    cost, value = secret_scan.GuessCost(), "kT9#vQ2!mZ4p"
    texts = [f"The secret password = {value}", f"bearer token: {value}", f"SECRET_KEY = '{value}'", f"secret: password: {value}",
             f"the secret key is {value}", f"secretKey={value}", f"TOKEN_SECRET_2 := {value}", f"password: {value} token", f"token {value}"]
    for text in texts:
        (start, _, end, _), = secret_scan.guess_spans(text, cost, 40.0, secret_scan.base_spans(text))
        assert text[start:end] == value
    for text in ("the secret password is password: token", "secret_key = changeme", "token token token"):
        assert secret_scan.guess_spans(text, cost, 40.0, []) == []
    # Names that come again and again cost linear time.
    for block in ("token:", "token", "secret "):
        text = block * 2_000 + "= " + value
        (start, _, end, _), = secret_scan.guess_spans(text, cost, 40.0, [])
        assert text[start:end] == value


# --- mixing -------------------------------------------------------------------------------------------------------

def test_mix_meets_targets(spark):
    rnd = random.Random(4)
    texts = [prose(rnd, rnd.randint(1, 60)) for _ in range(600)] + odd_texts()[:3]
    df = clashing(documents(spark, texts))
    got = mixing.mix_table(df).collect()
    again = mixing.mix_table(df.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    by_source, size = {}, Counter()
    for r in got:
        source = f"s{r['doc_id'] % 3}" if r["doc_id"] % 5 else None
        assert r["taken"] <= 2 * r["size"] and r["size"] == len((texts[r["doc_id"]] or "").split())
        size[source] += r["size"]
        by_source.setdefault(source, [r["target"], 0])[1] += r["taken"]
    weights = dict(zip(["s0", "s1", "s2", None], [5, 2, 1, 5]))
    want, left, open_ = {}, 1.5 * sum(size.values()), set(size)
    while True:  # the excess is shared again until nobody is above
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * size[s]}
        if not full:
            want |= share
            break
        want |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ -= full
    for s, (target, taken) in by_source.items():
        assert target == pytest.approx(want[s]) and abs(taken - target) <= 60
    copies = Counter(r["doc_id"] for r in mixing.mix(df).collect())
    assert all(copies[r["doc_id"]] == r["copies"] for r in got)
    assert mixing.mix(df).columns == df.columns and mixing.mix_table(df.limit(0)).count() == 0


# --- licenses -----------------------------------------------------------------------------------------------------

def test_license_places_and_labels(spark):
    texts = ["Under the MIT license, under the mit license!", "x Apache License, Version 2 y", "cc by-nc", "CC BY ND",
             "This work is licensed under the GNU GPL General Public License, version 3.", "redistribution and use in source", None,
             "éunder the mit license", "LICENSED under the very Apache License version 2.0"]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(clashing(documents(spark, texts + odd_texts()))).collect()}
    assert len(got) == len(texts) + len(odd_texts())
    assert tuple(got[0])[1:6] == (8, 2, 0, 4, "mit")
    assert tuple(got[1])[1:6] == (6, 1, 1, 1, "apache-2")
    assert got[2]["base_labels"] == "cc-by-nc" and got[3]["base_labels"] == ""
    assert got[4]["labels"] == "gpl-3" and 0.75 <= got[4]["score"] <= 1  # a word more: two diagonals merge
    assert got[5]["labels"] == "" and got[6]["n_words"] == 0 and got[7]["n_base"] == 0
    assert got[8]["labels"] == "apache-2"
    assert licenses.scan_licenses(documents(spark, texts).limit(0)).count() == 0


def test_a_word_tells_licenses_apart(spark):
    notice = "This work is licensed under a Creative Commons Attribution{} 4.0 International License"
    want = {"": "cc-by", "-NonCommercial": "cc-by-nc", "-ShareAlike": "cc-by-sa", "-NoDerivatives": "cc-by-nd", "-NoDerivs": "cc-by-nd",
            "-NonCommercial-ShareAlike": "cc-by-nc-sa", "-NonCommercial-NoDerivatives": "cc-by-nc-nd"}
    texts = [notice.format(w) for w in want] + [notice.format("-ShareAlike") + ". " + notice.format(""), notice.format(" very")]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(len(texts))] == [*want.values(), "cc-by,cc-by-sa", "cc-by"]
    assert [got[i]["n_spans"] for i in range(len(texts))] == [1] * len(want) + [2, 1]
    assert got[0]["score"] == 1 and 0.75 <= got[len(want) + 1]["score"] < 1


# --- toxicity -----------------------------------------------------------------------------------------------------

def brute_segments(scores):
    """Maximal segments by their definition, recursively: the best one, then what is left and right of it."""
    if not any(s > 0 for s in scores):
        return []
    best, at = None, None
    for i in range(len(scores)):
        for j in range(i, len(scores)):
            s = sum(scores[i:j + 1])
            if best is None or s > best or (s == best and j - i < at[1] - at[0]):
                best, at = s, (i, j)
    i, j = at
    return brute_segments(scores[:i]) + [(best, i, j)] + [(s, a + j + 1, b + j + 1) for s, a, b in brute_segments(scores[j + 1:])]


def test_segments_are_all_maximal():
    rnd = random.Random(6)
    for _ in range(300):
        own = {i: rnd.choice([-3, -1.5, 2.25, 4.125, 7.0625]) + rnd.random() / 64 for i in range(25) if rnd.random() < 0.4}
        scores = [own.get(i, -1.0) for i in range(25)]
        got = toxicity.segments(sorted(own.items()), -1.0)
        want = brute_segments(scores)
        assert [(a, b) for _, a, b in got] == [(a, b) for _, a, b in want]
        assert [s for s, _, _ in got] == pytest.approx([s for s, _, _ in want])


def test_toxicity_held_out(spark):
    rnd = random.Random(8)
    texts, labels = [], []
    for i in range(600):
        words, bad = prose(rnd, rnd.randint(20, 120)).split(), rnd.random() < 0.3
        for _ in range(4 if bad else 0):
            words[rnd.randrange(len(words))] = rnd.choice(["vilest", "grotty", "foulness"])
        texts.append(" ".join(words))
        labels.append((i, int(bad)))
    df = clashing(documents(spark, texts + odd_texts()))
    known = spark.createDataFrame(labels + [(3, labels[3][1]), (None, 1)], "doc_id long, toxic int").withColumn("quality", F.lit(1))
    rows = {r["doc_id"]: r for r in toxicity.toxicity_table(df, known).collect()}
    assert len(rows) == len(texts) + len(odd_texts()) and all(0 <= r["score"] <= 1 for r in rows.values())
    held = [i for i, _ in labels if rows[i]["held_out"]]
    assert 60 < len(held) < 200
    assert sum(rows[i]["predicted"] == labels[i][1] for i in held) / len(held) > 0.97
    assert all(rows[i]["predicted"] == 0 for i in range(600, len(rows)))
    toxic = next(i for i in held if labels[i][1])
    start, end = map(int, rows[toxic]["passages"].split(",")[0].split(":"))
    assert re.search("vilest|grotty|foulness", texts[toxic][start:end])
    none = toxicity.toxicity_table(df, known.limit(0)).collect()
    assert len(none) == len(rows) and {r["predicted"] for r in none} == {0}


# --- pieces -------------------------------------------------------------------------------------------------------

def test_pieces_equal_merging_by_score(spark):
    vocabulary = pieces.Vocabulary()
    encoder, decoder, rnd = pieces.Encoder(vocabulary), pieces.Decoder(vocabulary), random.Random(9)

    def whole(text):  # merging over the whole text, without cuts
        parts = pieces.steps_of("▁" + text.replace(" ", "▁"), vocabulary.scores)[0] if text else []
        return [i for p in parts for i in ([vocabulary.ids[p]] if p in vocabulary.ids else [vocabulary.byte_ids[b] for b in p.encode()])]

    texts = ["", " ", "  a   b  ", "\x00a\x00", "日本 執\t", "aé\U0001F600b", "a" * 200, " " * 40, "<s> <0x41>"]
    texts += ["".join(rnd.choice("abcdefgth  éñ\n012日") for _ in range(rnd.randint(1, 60))) for _ in range(300)]
    texts += ["".join(rnd.choice(vocabulary.texts[259:]) for _ in range(5)) for _ in range(300)]
    got = [ids.tolist() for ids in encoder.encode(texts)]
    assert got == [whole(t) for t in texts]
    assert [decoder.decode(i) for i in got] == [t.replace("▁", " ") for t in texts]


def test_piece_columns(spark):
    texts = odd_texts()
    df = clashing(documents(spark, texts))
    encoded = pieces.encode_documents(df)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(encoded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    table = pieces.encoding_table(df).collect()
    assert len(table) == len(texts) and all(r["round_trip"] for r in table)
    assert pieces.encode_documents(df.limit(0)).count() == 0


# --- near-duplicates ----------------------------------------------------------------------------------------------

def brute_components(texts):
    sets = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(words[i:i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(s), find(i)) for i, s in enumerate(sets)]


def edited(rnd, text, n):
    words = text.split()
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"w{rnd.randrange(10**6)}"
    return " ".join(words)


def test_groups_of_copies(spark):
    """A large family whose members mostly link to its source only, chains of edits, and exact copies."""
    rnd = random.Random(10)
    source = prose(rnd, 120)
    texts = [edited(rnd, source, rnd.randint(1, 6)) for _ in range(250)] + [source]
    chain = prose(rnd, 150)
    for _ in range(12):
        texts.append(chain)
        chain = edited(rnd, chain, 3)
    texts += [prose(rnd, 4)] * 3 + ["A b C", "a B c", "a b", ""] + [prose(rnd, rnd.randint(1, 200)) for _ in range(60)] + odd_texts()
    rnd.shuffle(texts)
    df = clashing(documents(spark, texts))
    for block in (256, 16):
        got = {r["doc_id"]: r for r in minhash.near_duplicates(df, block=block).collect()}
        assert [(got[i]["n_shingles"], got[i]["component_id"]) for i in range(len(texts))] == brute_components(texts)
    kept = {r["doc_id"] for r in minhash.keep_one(df).collect()}
    assert kept == {i for i in got if got[i]["kept"]} == {got[i]["component_id"] for i in got}


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "G h i j k l"), (None, "a b c d e f"), (4, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == {(1, 1, True): 2, (2, 1, False): 1, (None, None, True): 1, (4, 4, True): 1}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


# --- repeated strings ---------------------------------------------------------------------------------------------

def brute_repeats(texts, size):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + size] for r in raw for i in range(len(r) - size + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - size + 1):
            if seen[r[i:i + size]] > 1:
                gone[i:i + size] = [True] * size
        kept = bytes(b for b, g in zip(r, gone) if not g)
        out.append((len(r), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("size,gram,group", [(200, 24, 4096), (60, 8, 3)])
def test_repeated_strings(spark, size, gram, group):
    rnd = random.Random(11)
    shared = prose(rnd, 40)
    texts = [None, "", "a" * 500, "ab" * 300, "é" * 150, "x" * 200]
    for _ in range(50):
        t = prose(rnd, rnd.randint(5, 80))
        if rnd.random() < 0.5:
            t += " " + shared[:rnd.randint(20, len(shared))] + prose(rnd, rnd.randint(0, 40))
        if rnd.random() < 0.3:
            t += t
        texts.append(t)
    texts += [edited(rnd, t, 2) for t in texts[10:30]] + [texts[20]] * 2
    df = clashing(documents(spark, texts))
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats_table(df, size, gram=gram, group=group).collect()}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, size)


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 2000)
    rnd = random.Random(12)
    text = prose(rnd, 1500)
    texts = [text, prose(rnd, 300) + text[1500:4200] + prose(rnd, 10), text[4000:4150] + "y" + text[4150:6000]]
    for t in texts:
        parts = list(suffixes._pieces(t.encode(), 60))
        assert all(any(base <= i and i + 60 <= base + len(p) for base, p in parts) for i in range(len(t.encode()) - 59))
    assert suffixes.repeats_table(documents(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("chunk", [1, 1 << 20])
def test_cuts_of_long_texts_repeat_nothing(spark, monkeypatch, chunk):
    monkeypatch.setattr(suffixes, "PIECE", 2000)
    monkeypatch.setattr(suffixes, "CHUNK", chunk)
    rnd = random.Random(13)
    word = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    texts = [word(n) for n in (1999, 2000, 2001, 1820, 1940, 3700, 9000)]
    texts += [texts[-1][1500:4200] + word(3000), word(2500) + texts[-1][5000:5150] * 2 + word(1500)]
    got = {r["doc_id"]: tuple(r)[1:] for r in suffixes.repeats_table(documents(spark, texts), 60, gram=8).collect()}
    want = brute_repeats(texts, 60)
    assert [got[i] for i in range(len(texts))] == want and [w[1] for w in want[:6]] == [0] * 6
