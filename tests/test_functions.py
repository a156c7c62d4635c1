import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dokuma.functions import hashing, markup, turkish


#: Misread letters, leading dashes, styles, stage directions, credits, songs and lines without letters.
SUBTITLES = [
    ("Yarın görüşürüz.", "Yarın görüşürüz."),
    ("SoIdaki kapı açıkmış", "Soldaki kapı açıkmış"), ("YoIIar kapaIı", "Yollar kapalı"), ("O an çok sakinIeşti.", "O an çok sakinleşti."),
    ("Isparta ILGAZ", "Isparta ILGAZ"), ("Defne Ilgın'la konuştu", "Defne Ilgın'la konuştu"),
    ("-Tamam mı?", "Tamam mı?"), ("--  Bekle", "Bekle"), ("<b>- Otur şuraya</b>", "Otur şuraya"), ("Geldim -Gittim", "Geldim -Gittim"),
    ("{\\i1}Gece yarısı", "Gece yarısı"), ('<span class="x">Deniz</span> kıyısı', "Deniz kıyısı"), ("a < b olmalı", "a < b olmalı"),
    ("[KAPI GICIRDAR] Kim o?", "Kim o?"), ("[rüzgâr}", ""), ("{4410Geç kaldık", "Geç kaldık"), ("Peki (iç çeker) olsun", "Peki (iç çeker) olsun"),
    ("Çeviri: bir gönüllü", ""), ("bkz. http örnek", ""), ("Altyazı ekibi", ""), ("Çevirmen geldi", "Çevirmen geldi"),
    (" \t çok \t boşluk  ", "çok boşluk"), ("♫ la la ♫", ""), ("?!", ""), ("- 42 -", ""), ("", ""),
]


@pytest.mark.parametrize(("line", "expected"), SUBTITLES)
def test_subtitle_lines(line, expected):
    assert markup.subtitle_clean(line) == expected


def test_subtitle_keeps_broken_bytes():
    assert markup.subtitle_clean_bytes(b"ab\xc3") == b"ab\xc3"


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("su&lt;ref name=k&gt;s. 12&lt;/ref&gt; akar", "su akar"), ("{{bilgi kutusu|ad=Göl}}Göl derindir.", "Göl derindir."), ("x{{a{{b}}{{c|{{d}}}}}}y", "xy"),
        ("[[Göl|göller]] ve [[nehir]]", "göller ve nehir"), ("[[a|b|c]]", "c"), ("[[Category:Lakes]]son", "son"), ("[[File:map.svg|right|[[x]] map]]son", "son"),
        ("[https://a.b/c site adı], [http://tek]", "site adı, "), ("''eğik'' '''kalın''' '''''ikisi'''''", "eğik kalın ikisi"), ("=== Alt ===\nmetin", " Alt \nmetin"),
        ("bir&lt;!-- gizli {{ --&gt;iki", "biriki"), ("R&amp;D &quot;ad&quot; 2 &gt; 1", 'R&D "ad" 2 > 1'), ("on&nbsp;iki", "on iki"), ("p&lt;ref group=n /&gt;q&lt;math&gt;e^x&lt;/math&gt;r", "pqr"),
        ("önce{| class=t\n|-\n|}sonra", "öncesonra"), ("kapanmayan {{kutu", "kapanmayan "), ("&#x131;&#351;&#x;", "ış&#x;"), ("a&lt;br/&gt;b", "ab"),
    ],
)
def test_wikitext(text, expected):
    assert markup.wikitext_clean(markup.xml_unescape(text)) == expected


#: The suffix that a gloss names. Stems are our own: hard and soft ends, vowels of each harmony.
@pytest.mark.parametrize(
    ("gloss", "words"),
    [
        ("cogul", {"masa": "masalar", "dil": "diller", "köy": "köyler"}), ("iyelik-1tekil", {"dolap": "dolabım", "kedi": "kedim", "gül": "gülüm"}),
        ("iyelik-3tekil", {"kutu": "kutusu", "taç": "tacı", "yol": "yolu"}), ("belirtme-hali(akuzatif)", {"kapı": "kapıyı", "ağaç": "ağacı", "un": "unu"}),
        ("yonelme-hali(datif)", {"sokak": "sokağa", "deniz": "denize", "ordu": "orduya"}), ("bulunma-hali(lokatif)", {"park": "parkta", "köprü": "köprüde"}),
        ("ayrilma-hali(ablatif)", {"ip": "ipten", "dağ": "dağdan"}), ("tamlayan-hali(genitif)", {"kuş": "kuşun", "dere": "derenin"}),
        ("isimlestirme(-lık)", {"iyi": "iyilik", "dost": "dostluk"}), ("yoksunluk(-sız)", {"ses": "sessiz", "suç": "suçsuz"}), ("sahiplik(-lı)", {"akıl": "akıllı", "gölge": "gölgeli"}),
        ("meslek/ugras(-cı)", {"saat": "saatçı", "gemi": "gemici"}), ("mastar(infinitif)", {"bul": "bulmak", "sev": "sevmek"}), ("olumsuzluk", {"sor": "sorma", "bil": "bilme"}),
        ("simdiki-zaman", {"uyu": "uyuyor", "gör": "görüyor"}), ("digecmis-zaman", {"koş": "koştu", "ver": "verdi"}), ("yeterlilik(-ebil)", {"al": "alabil", "bekle": "bekleyebil"}),
    ],
)
def test_suffixes(gloss, words):
    suffix = next(s for s in turkish.SUFFIXES if s.gloss == gloss)
    assert {stem: turkish.attach(stem, suffix) for stem in words} == words


def test_suffix_columns_agree(spark, tmp_path):
    """The column expression against the function, for the words of a table."""
    from dokuma.plans.queries import q27_suffix_resolve

    text = "Ev araba okul kitap ağaç göz süt kapı oku git tuz gel yap renk, Ğü xyz BRR saat çift İş ISI"
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = q27_suffix_resolve(spark, str(tmp_path)).collect()
    assert len(rows) == 21 * len(turkish.SUFFIXES) and {"brr", "iş", "ısı"} < {r["stem"] for r in rows}
    for r in rows:
        assert turkish.attach(r["stem"], turkish.SUFFIXES[r["suffix_id"]]) == r["word"]


class Plain:
    """The generator step by step."""

    def __init__(self, seed, sequence):
        self.step, self.state = (2 * sequence + 1) % 2**64, 0
        self()
        self.state = (self.state + seed) % 2**64
        self()

    def __call__(self):
        old = self.state
        self.state = (old * hashing.MULTIPLIER + self.step) % 2**64
        x, turn = (((old >> 18) ^ old) >> 27) % 2**32, old >> 59
        return (x >> turn | x << (-turn % 32)) % 2**32


def test_generator_matches_published_outputs():
    assert [int(x) for x in hashing.pcg_u32(42, 54, np.arange(6))] == [0xA15C02B7, 0x7B47F409, 0xBA1D3330, 0x83D2F293, 0xBFA4784B, 0xCBED606E]


@given(st.integers(0, 2**63), st.integers(0, 2**31))
@settings(max_examples=20, deadline=None)
def test_jump_ahead_equals_stepping(seed, sequence):
    plain = Plain(seed, sequence)
    assert [plain() for _ in range(40)] == [int(x) for x in hashing.pcg_u32(seed, sequence, np.arange(40))]


def test_draws():
    assert abs(hashing.pcg_normal(7, 1, 20000).std() - 1) < 0.03
    assert abs(hashing.pcg_uniform(7, 1, np.arange(20000)).mean() - 0.5) < 0.01
    assert sorted(hashing.shuffled(50, 3, 4)) == list(range(50))


def test_rejected_draws_are_drawn_again():
    """With a size just over 2^63 nearly half of all values are rejected."""
    size, plain = 2**63 + 12345, Plain(5, 9)
    expected = []
    while len(expected) < 300:
        high = plain()
        value = high << 32 | plain()
        if value >= 2**64 % size:
            expected.append(value % size)
    got = hashing.pcg_range(5, 9, np.arange(300), size)
    assert [int(x) % 2**64 for x in got] == expected
    assert [int(x) % 2**64 for x in hashing.pcg_range(5, 9, np.array([250, 299]), size)] == [expected[250], expected[299]]


def test_fnv_column(spark):
    rows = spark.createDataFrame([("",), ("a",), ("ağaç",), (None,)], "t string").select("t", hashing.fnv1a_col("t").alias("h")).collect()
    for r in rows:
        assert r["h"] is None if r["t"] is None else r["h"] % 2**64 == hashing.fnv1a(r["t"].encode())


def test_lower_and_words(spark):
    row = spark.createDataFrame([("ISPARTA İzmir'de ŞÖÜĞÇ âb",)], "t string").select(turkish.lower_col(F.col("t")).alias("l"), turkish.words(F.col("t")).alias("w")).first()
    assert row["l"] == "ısparta izmir'de şöüğç âb" and row["w"] == ["ISPARTA", "İzmir", "de", "ŞÖÜĞÇ", "b"]
