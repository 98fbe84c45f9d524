import base64
import quopri
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import leaks, mime
from tests.conftest import rows

TEXT = "Grüße aus dem Labor: 5 % mehr als zuvor."


def part(text, charset="utf-8", encoding="8bit", kind="text/plain", extra=""):
    body = text
    if encoding == "base64":
        body = base64.encodebytes(text.encode(charset)).decode()
    elif encoding == "quoted-printable":
        body = quopri.encodestring(text.encode(charset)).decode("ascii")
    return f"Content-Type: {kind}; charset={charset}\nContent-Transfer-Encoding: {encoding}\n{extra}\n{body}"


@pytest.mark.parametrize("charset", ["utf-8", "iso-8859-1", "windows-1252", "ISO-8859-2"])
@pytest.mark.parametrize("encoding", ["base64", "quoted-printable"])
def test_encodings(charset, encoding):
    text = TEXT if charset != "ISO-8859-2" else "Zażółć gęślą jaźń"
    assert mime.readable_text("From: a@b.test\n" + part(text, charset, encoding)).strip() == text


def test_multipart():
    b = "=_x"
    inner = [part("plain one"), part("<p>two &amp; <b>th</b>ree<br>four</p>", kind="text/html"), part("AAAA", encoding="base64", kind="application/octet-stream"), part("attached", extra='Content-Disposition: attachment; filename="a.txt"\n')]
    raw = f'Subject: x\nContent-Type: multipart/mixed;\n boundary="{b}"\n\npreamble\n' + "".join(f"--{b}\n{p}\n" for p in inner) + f"--{b}--\nepilogue"
    got = mime.readable_text(raw).split()
    assert got == ["plain", "one", "two", "&", "three", "four", "attached"]
    assert mime.readable_text(raw.replace("\n", "\r\n")).split() == got
    deep = part("innermost")
    for k in range(60):
        deep = f"Content-Type: message/rfc822\n\n{deep}" if k % 2 else f'Content-Type: multipart/mixed; boundary="b{k}x"\n\n--b{k}x\n{deep}\n--b{k}x--\n'
    assert mime.readable_text("From: x\n" + deep).split() == ["innermost"]
    cut = raw[: raw.index("attached") + 4]
    assert mime.readable_text(cut).split()[-1] == "atta"


def test_damage():
    assert mime.readable_text(None) == "" == mime.readable_text("")
    assert mime.readable_text("no headers at all").strip() == "no headers at all"
    whole = "From: x\n" + part("ä" * 50, encoding="base64")
    assert set(mime.readable_text(whole[: len(whole) - 21])) <= {"ä", "\n"}
    assert mime.readable_text("From: x\n" + part("abc", charset="no-such-set").replace("utf-8", "x")) == "abc"
    assert mime.readable_text("A: b\nContent-Type: multipart/mixed\n\ntext") == "text"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("Content-Type: multipart/text; boundary=x\n--<&>=äб"), max_size=200))
def test_anything_is_read(text):
    mime.readable_text(text)


@pytest.mark.parametrize("errors,radius", [(0, 3), (1, 7), (2, 11)])
def test_candidates_are_all_within_the_radius(errors, radius):
    import numpy as np

    rnd = np.random.default_rng(1)
    base = rnd.integers(0, 2**63, 50, dtype=np.uint64)
    index = leaks.HammingIndex(base, errors)
    probe = np.concatenate([base ^ np.uint64(sum(1 << int(b) for b in rnd.choice(64, k, replace=False))) for k in (0, 1, 2, 3, 4, 7, 8, 10, 11, 12)])
    i, j = index.candidates(probe)
    got = list(zip(i.tolist(), j.tolist()))
    want = [(a, b) for a in range(len(probe)) for b in range(50) if bin(int(probe[a] ^ base[b])).count("1") <= radius]
    assert index.radius == radius and sorted(got) == want and len(set(got)) == len(got)


def test_weighted_fingerprints_against_plain_sums():
    import numpy as np

    rnd = np.random.default_rng(5)
    h, w = rnd.integers(0, 2**63, 3000, dtype=np.uint64), rnd.integers(0, 4, 3000).astype(np.uint8)
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).astype(int) * w[:, None]
    for stride, got in ((1, leaks.weighted_fingerprints(h, w, [20, 68], 1)), (4, leaks.weighted_fingerprints(h, w, [20, 68], 4))):
        for size in (20, 68):
            want = [np.packbits(2 * bits[k : k + size].sum(0) > w[k : k + size].sum()).view(np.uint64)[0] for k in range(0, 3000 - size + 1, stride)]
            assert got[size].tolist() == [int(x) for x in want]


def test_similarity_against_plain_loops():
    import numpy as np

    rnd = np.random.default_rng(6)
    doc = rnd.integers(1, 9, 300, dtype=np.uint64)
    item, weight = np.stack([doc[40:70], rnd.integers(1, 9, 30, dtype=np.uint64), np.r_[doc[100:110], 99, doc[110:129]].astype(np.uint64)]), rnd.integers(1, 4, (3, 30)).astype(np.uint8)
    starts = np.array([40, 290, 100])
    got = leaks.similarity(doc, starts, item, weight)
    for g, a, x, w in zip(got, starts, item, weight):
        word = lambda k: doc[k] if 0 <= k < len(doc) else None
        off = range(-leaks.SLACK, leaks.SLACK + 1)
        ways = [(d, e, k) for d in off for e in (d - 1, d, d + 1) if e in off for k in range(1, 5)]
        total = sum(max(sum(int(w[s + k]) for k in range(5) if word(a + s + k + (d if k < split else e)) == x[s + k]) for d, e, split in ways) for s in range(26))
        assert g == pytest.approx(total / sum(int(w[s + k]) for s in range(26) for k in range(5)))
    assert got[0] == 1 and 0.8 < got[2] < 1


def test_fingerprints_against_plain_sums():
    import numpy as np

    rnd = np.random.default_rng(2)
    s = rnd.integers(0, 2**63, 40, dtype=np.uint64)
    for per in (1, 2, 5, 8, 13):
        bits = np.unpackbits(s.view(np.uint8)).reshape(-1, 64).astype(int)
        want = [np.packbits(bits[k : k + per].sum(0) > per // 2).view(np.uint64)[0] for k in range(41 - per)]
        assert leaks.fingerprints(s, per).tolist() == [int(x) for x in want]


def brute(docs, items, n=12):
    grams = {i: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for i, t in items for w in [leaks.words(t or "")]}
    out = set()
    for d, t in docs:
        w = leaks.words(mime.readable_text(t))
        own = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
        out |= {(d, i) for i, g in grams.items() if own & g}
    return out


def test_found_against_brute_force(spark):
    rnd = random.Random(4)
    vocab = [f"w{i}" for i in range(300)] + ["Größe", "Ⅷ", "ÉTÉ", "don't"]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.choice([8, 12, 40, 90])))) for i in range(30)] + [(99, None), (98, "")]
    docs = []
    for d in range(300):
        text = [rnd.choice(vocab) for _ in range(rnd.randrange(0, 200))]
        for _ in range(rnd.randrange(3)):
            w = items[rnd.randrange(30)][1].split()
            a = rnd.randrange(len(w))
            piece = w[a : a + rnd.choice([10, 11, 12, 13, 60])]
            if rnd.random() < 0.3 and len(piece) > 6:
                piece[rnd.randrange(len(piece))] = "changed"
            at = rnd.randrange(len(text) + 1)
            text[at:at] = piece
        text = "> ".join(" ".join(text[k : k + 9]) + "\n" for k in range(0, len(text), 9))
        docs.append((d, part(text.upper() if d % 2 else text, encoding=["8bit", "base64", "quoted-printable"][d % 3])))
    docs += [(1500, None), (1501, ""), (1502, part("word " * 60_000)), docs[3]]
    df = spark.createDataFrame([(d, t, "x", 1.0) for d, t in docs], "doc_id long, text string, item_id string, similarity double")
    it = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > 30
    for most in (50_000, 300):
        got = leaks.leaks(df.repartition(3), it, index_windows=most, batch=17)
        assert rows(leaks.found(got)) == sorted(want, key=repr)
    assert leaks.leaks(df.limit(0), it).count() == 0
    assert leaks.leaks(df, it.limit(0)).count() == 0
    with pytest.raises(ValueError):
        leaks.leaks(df, it, window=4)


def edited(w, every, how, rnd):
    out, off = [], rnd.randrange(every)
    for k, x in enumerate(w):
        if k % every == off:
            out += {"change": [f"new{rnd.randrange(999)}"], "put in": [f"new{rnd.randrange(999)}", x], "leave out": []}[how]
        else:
            out.append(x)
    return out


@pytest.mark.parametrize("every", [8, 10, 14, 20])
def test_recall_on_edited_passages(spark, every):
    """Items with one word in so many changed, put in or left out; whole and in part."""
    rnd = random.Random(every)
    vocab = [f"w{i}" for i in range(2000)] + ["the", "of", "and", "in"] * 150
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randrange(24, 280)))) for i in range(60)]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        if i % 2:  # a part as large as a window of the item's size
            size = max(s for s in leaks.ITEM_SIZES if s <= len(w))
            a = rnd.randrange(len(w) - size + 1)
            w = w[a : a + size + (len(w) - size - a) // 2]
        filler = [rnd.choice(vocab) for _ in range(300)]
        at = rnd.randrange(300)
        docs.append((i, "A: b\n\n" + " ".join(filler[:at] + edited(w, every, ["change", "put in", "leave out"][i % 3], rnd) + filler[at:])))
        want.add((i, i))
    docs += [(1000 + k, "A: b\n\n" + " ".join(rnd.choice(vocab) for _ in range(400))) for k in range(100)]
    it = spark.createDataFrame(items, "item_id long, text string")
    pairs = leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), it).collect()
    got = {(r["doc_id"], r["item_id"]) for r in pairs}
    assert got <= want and len(got) >= 0.9 * len(want)
    assert any(0.8 <= r["similarity"] < 1 and r["common_words"] == 0 for r in pairs) or every > 12


def test_layout_does_not_matter(spark):
    """A document gives the same whatever lies before it in its batch."""
    rnd = random.Random(8)
    item = [f"t{i}" for i in range(68)]
    docs = [(k, "A: b\n\n" + " ".join(["x"] * (k % 5) + edited(item, 9, "change", rnd))) for k in range(30)]
    it = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = rows(leaks.leaks(df.coalesce(1), it, batch=30))
    assert len(want) >= 27
    assert rows(leaks.leaks(df.repartition(4), it, batch=7)) == want
