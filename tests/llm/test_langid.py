import random

import pytest

from strandline.llm import langid
from tests.conftest import rows

# a few sentences of each language, to be shuffled into documents
WORDS = {
    "en": "the of and to in that is was for with his they have this from which would there their what about when could people after because through",
    "de": "der die und das ist nicht ein eine mit auf für sich von dem werden wurde noch nach auch über zwischen können während durch gegen möchte",
    "fr": "le la les des et une est pas pour dans que qui avec sur nous vous être cette plus aussi très après même toujours pendant depuis",
    "es": "el los las una que por con para está pero como más muy también después desde hasta entre cuando donde siempre nunca señor año",
    "pt": "o os as uma que não com para está mas como mais muito também depois desde até entre quando onde sempre nunca senhor ano então",
    "it": "il gli le una che non con per sono ma come più molto anche dopo fino tra quando dove sempre mai signore anno della questo perché",
    "nl": "de het een van en niet met voor zijn maar als ook naar door over tussen wanneer waar altijd nooit jaar deze omdat tijdens zonder worden",
    "sv": "det en ett och inte med för som är men också efter mellan när där alltid aldrig år denna eftersom under utan blev från över",
    "pl": "nie jest się na że do jak ale także po między kiedy gdzie zawsze nigdy rok ponieważ podczas bez został przez który będzie oraz więc",
    "ru": "не что это как для все его так было после между когда где всегда никогда год потому время без стал через который будет также если",
}


def sentence(rnd, lang, n=14):
    w = WORDS[lang].split()
    return " ".join(rnd.choice(w) for _ in range(n)).capitalize() + "."


def body(rnd, lang, n=6):
    return "\n".join(sentence(rnd, lang) for _ in range(n))


def message(text):
    return f"From: a@b.test\nContent-Type: text/plain; charset=utf-8\n\n{text}\n"


@pytest.fixture(scope="module")
def net():
    rnd = random.Random(1)
    labels = [c for c in WORDS for _ in range(30)]
    wrong = [rnd.choice(list(WORDS)) if rnd.random() < 0.1 else c for c in labels]
    return langid.train([message(body(rnd, c)) for c in labels], wrong, steps=400)


def test_held_out_accuracy(net):
    rnd = random.Random(2)
    truth = [rnd.choice(list(WORDS)) for _ in range(300)]
    got = langid.segments_of([message(body(rnd, c)) for c in truth], net)
    right = sum(len(s) == 1 and s[0][0] == c for s, c in zip(got, truth))
    assert right / len(truth) > 0.97
    assert all(0 < p <= 1 for s in got for _, p, *_ in s)


def test_lost_accents(net):
    rnd = random.Random(3)
    truth = [rnd.choice(["de", "fr", "es", "pl", "sv"]) for _ in range(100)]
    got = langid.segments_of([message(langid.strip_accents(body(rnd, c))) for c in truth], net)
    assert sum(s[0][0] == c for s, c in zip(got, truth)) > 90


def test_mixed_passages(net):
    rnd = random.Random(4)
    hits = 0
    for _ in range(60):
        a, b = rnd.sample(list(WORDS), 2)
        (s,) = langid.segments_of([message(body(rnd, a, 5) + "\n\n> " + sentence(rnd, b, 20) + " " + sentence(rnd, b, 14))], net)
        _, main, _, langs, _, status = langid.verdict(a, s, 15)
        hits += status == "mixed" and set(langs) == {a, b} and main == a
    assert hits > 54


def test_what_is_no_body(net):
    rnd = random.Random(5)
    text = (
        body(rnd, "en") + "\n\nBest regards,\n\nAnna Nowak\n\n+00 555 0100 | anna@b.test\n\n--------------------\n"
        "Diese Nachricht ist nur für den genannten Empfänger bestimmt. Sollten Sie sie\nirrtümlich erhalten haben, löschen Sie sie bitte und benachrichtigen Sie den Absender.\n\n"
        "Am 2031-03-05 10:11 schrieb Jan Kowalski:\n\n> " + sentence(rnd, "en")
    )
    (s,) = langid.segments_of([message(text)], net)
    assert langid.verdict("en", s, 15)[3] == ["en"] and all("Empfänger" not in x[3] and "2031" not in x[3] for x in s)


@pytest.mark.parametrize("label,code", [("EN", "en"), ("en-US", "en"), ("deu", "de"), ("ger", "de"), ("German", "de"), (" pt_BR ", "pt"), ("lb", None), ("utf-8", None), ("", None), (None, None)])
def test_labels(label, code):
    assert langid.label_language(label) == code


def test_verdicts():
    seg = lambda c, n, p=0.9: (c, p, n, "x")
    assert langid.verdict("en", [seg("en", 30)], 15)[5] == "ok"
    assert langid.verdict("fr", [seg("en", 30)], 15)[5] == "wrong"
    assert langid.verdict("lb", [seg("en", 30)], 15)[5] == "wrong"
    assert langid.verdict("und", [seg("en", 30)], 15)[5] == "missing"
    assert langid.verdict(None, [seg("en", 30), seg("fr", 14)], 15)[5] == "missing"
    assert langid.verdict("en", [seg("en", 30), seg("fr", 15)], 15)[3] == ["en", "fr"]
    assert langid.verdict("en", [seg("en", 9)], 15)[5] == "short"
    assert langid.verdict("en", [], 15)[1] is None


def test_windows():
    x, owner = langid.windows_of(["a" * 10, "", "b" * 200])
    assert x.shape[1] == langid.WINDOW and set(owner) == {0, 1, 2} and (owner == 2).sum() == 4
    assert langid.windows_of([])[0].shape == (0, langid.WINDOW)


def test_compiled_tables_give_what_the_network_gives(net):
    import numpy as np

    x, _ = langid.windows_of([sentence(random.Random(i), "fr", 30) for i in range(20)])
    # the wider filters end three places before the window does in either form
    direct = net._forward(x)[2]
    assert np.abs(net.predict(x) - direct).max() < 0.2 and (net.predict(x).argmax(1) == direct.argmax(1)).mean() > 0.95


def test_tables(spark, net):
    rnd = random.Random(6)
    data = [(1, message(body(rnd, "en")), "English"), (2, message(body(rnd, "fr")), "en"), (3, message(body(rnd, "de")), None), (4, None, "en"), (5, "", None), (6, message(" ".join(["wort"] * 40_000)), "de"), (1, message("12345 !!!"), "en"), (None, message(body(rnd, "it")), "it")]
    df = spark.createDataFrame([(*x, "c", 1.0) for x in data], "doc_id long, text string, lang string, segment string, confidence double")
    got = {(r["doc_id"], r["status"]): r["lang"] for r in langid.documents(df, net).collect()}
    assert got[1, "ok"] == "en" and got[2, "wrong"] == "fr" and got[3, "missing"] == "de" and got[4, "short"] is None and got[1, "short"] is None and got[None, "ok"] == "it"
    assert langid.documents(df, net).count() == len(data)
    seg = langid.segments(df, net)
    assert {r[0] for r in rows(seg, "doc_id")} == {1, 2, 3, 4, 5, 6, None} and seg.where("doc_id = 4 and segment_no is null").count() == 1
    assert langid.documents(df.limit(0), net).count() == 0 and langid.segments(df.limit(0), net).count() == 0


def test_training_sample_is_bounded_and_stable(spark):
    data = [(i, f"text {i}", ["en", "English", "EN-us", "de", None, "xx"][i % 6]) for i in range(3000)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    a = langid.training_sample(df, 50)
    b = langid.training_sample(df.repartition(11), 50)
    assert a == b and a[1].count("en") == 50 and a[1].count("de") == 50
    assert langid.training_sample(df.limit(0)) == ([], [])
    assert langid.segments_of(["A: b\n\nhello there my friend"], langid.train([], []))[0]


def test_languages_that_are_not_known(net):
    """Words made of other syllables are in none of the languages; whole documents say so."""
    rnd = random.Random(12)
    syllables = [a + b for a in ("kx", "zv", "qh", "ŋg", "tłʼ", "xw", "dź") for b in ("õo", "ɨ", "ää", "uq", "ıy")]
    words = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(80)]
    text = " ".join(rnd.choice(words) for _ in range(60)) + "."
    (found,) = langid.segments_of([message(text)], net)
    assert [f[0] for f in found] == [langid.OTHER]
    assert langid.verdict("en", found, 15)[1:] == (langid.OTHER, pytest.approx(found[0][1]), [], [], "other")


def test_weights_are_kept(spark, net, tmp_path):
    langid.save(net, spark, str(tmp_path / "net"))
    x, _ = langid.windows_of([sentence(random.Random(3), c) for c in WORDS])
    assert (langid.load(spark, str(tmp_path / "net")).predict(x) == net.predict(x)).all()
