"""Kernels against expectations that the behaviour they follow is known by."""

import pytest

from linkloom.functions import names, thai
from linkloom.functions.similarity import composite, distinctive_score, jaro_winkler, levenshtein_similarity, trigram_similarity

CLEANED = [
    ("Mr. William Williams", "william williams"), ("Adams Thomas", "adams thomas"), ("Vincent Prince Inc.", "vincent prince"),
    ("Miss Emma Watson", "emma watson"), ("สมชาย ไทยนาย", "สมชาย ไทยนาย"), ("นาย สมชาย เข็มกลัด", "สมชาย เข็มกลัด"),
    ("นายสมชาย เข็มกลัด", "สมชาย เข็มกลัด"), ("Bangkok Bank Public Company Limited", "bangkok bank"),
    ("บริษัท สยามพารากอน ดีเวลลอปเม้นท์ จำกัด", "สยามพารากอน ดีเวลลอปเม้นท์"), ("KBank", "kasikornbank"), ("กสิกรไทย", "kasikornbank"),
]


@pytest.mark.parametrize(("raw", "cleaned"), CLEANED)
def test_cleaned(raw, cleaned):
    assert names.normalize(raw).cleaned == cleaned


def test_phonetic_keys():
    key = lambda t: names.normalize(t).phonetic_key
    assert key("somchai") == key("sumchai") != key("sonchai")


@pytest.mark.parametrize("pair", "ศิริ/สิริ ณัฐ/นัฐ ธนา/ทนา ภัทร/พัทร ชัย/ไชย พงษ์/พงศ์ พงษ์/พงส์ สุวรรณ/สุวัณณ์ ใจดี/ไจดี".split())
def test_phonetic_equal(pair):
    a, b = pair.split("/")
    assert thai.phonetic_form(a) == thai.phonetic_form(b)


@pytest.mark.parametrize("pair", "ราม/ลาม สมชาย/สมหญิง ชัย/ชาย".split())
def test_phonetic_different(pair):
    a, b = pair.split("/")
    assert thai.phonetic_form(a) != thai.phonetic_form(b)


@pytest.mark.parametrize("pair", "สมชาย/somchai สุชาติ/suchat ประเสริฐ/prasert วิชัย/wichai นภา/napha".split())
def test_skeleton_equal(pair):
    a, b = pair.split("/")
    assert thai.skeleton(thai.romanize(a)) == thai.skeleton(b)


@pytest.mark.parametrize("pair", "สมชาย/somsak วิชัย/wichian สมชาย/somchit".split())
def test_skeleton_different(pair):
    a, b = pair.split("/")
    assert thai.skeleton(thai.romanize(a)) != thai.skeleton(b)


SYLLABLES = {
    "สมชาย": [("สม", "ส", "", "ม"), ("ชาย", "ช", "า", "ย")], "วิชัย": [("วิ", "ว", "ิ", ""), ("ชัย", "ช", "ั", "ย")],
    "ธนากร": [("ธ", "ธ", "", ""), ("นา", "น", "า", ""), ("กร", "ก", "", "ร")], "กรุงเทพ": [("กรุง", "กร", "ุ", "ง"), ("เทพ", "ท", "เ", "พ")],
    "ABCD": [("ABCD", "", "", "")],
}


@pytest.mark.parametrize("text", SYLLABLES)
def test_syllables(text):
    assert [s[:4] for s in thai.syllables(text)] == SYLLABLES[text]


def test_syllables_keep_every_character():
    for i in range(50):
        text = "".join(chr(0x0E01 + (i * 37 + j * 11) % 0x4B) for j in range(12)) + "ab"
        assert "".join(s.text for s in thai.syllables(text)) == text


def test_parties():
    assert names.split_parties("บุญจันทร์ รัตแมดSB63000164") == ["บุญจันทร์ รัตแมด"]
    assert names.split_parties("จุฑาทิพย์ บุตรอินทร์ (คุณศรัณย์ พลับเจริญสุข)PL63001961") == ["คุณศรัณย์ พลับเจริญสุข", "จุฑาทิพย์ บุตรอินทร์"]
    assert names.split_parties("นายบุญจันทร์,นางวิลัย และ นายสมพงษ์ รัตแมด") == ["นายบุญจันทร์ รัตแมด", "นางวิลัย  รัตแมด", "นายสมพงษ์ รัตแมด"]
    assert names.split_parties("สมชาย ใจดี") == ["สมชาย ใจดี"]
    assert names.split_parties("a (b") == ["a (b"]
    assert names.split_parties("") == [""]


def score(a, b, days=None):
    return composite(names.normalize(a), names.normalize(b), days)


def test_composite_of_parties():
    assert score("บริษัท ไทยประกันชีวิต จำกัด", "นายสมพงษ์ รัตแมด,นางวิลัย ใจดี").total < 0.70
    assert score("ศรัณย์ พลับเจริญสุข", "จุฑาทิพย์ บุตรอินทร์ (คุณศรัณย์ พลับเจริญสุข)PL63001961").total >= 0.95
    assert score("บริษัท 193 นวัตกรรม จำกัด (สาขาที่ 1)", "บริษัท 193 นวัตกรรม จำกัด (สาขาที่ 99)").total < 0.90


def test_composite_dates_and_script():
    same = score("John Michael Smith", "Smith John Michael", 2)
    assert same.date == pytest.approx(0.9048) and same.total > 0.8 and not same.cross_script
    assert score("สมชาย ใจดี", "Somchai Jaidee").cross_script
    assert score("", "").total == 1.0


def test_similarities():
    assert jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert jaro_winkler("aXYZ", "aPQR") == pytest.approx(0.55)
    assert jaro_winkler("", "") == 1.0 and jaro_winkler("a", "") == 0.0
    assert levenshtein_similarity("kitten", "sitting") == pytest.approx(1 - 3 / 7)
    assert trigram_similarity("aab", "abb") == pytest.approx(3 / 5) or trigram_similarity("aab", "abb") < 1
    assert distinctive_score(["siam"], ["สยาม"], lambda t: 1.0) == (0.95, True)
