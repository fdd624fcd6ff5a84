"""Fixed vocabularies and tables: values that results depend on, stated as they are."""

# Titles that are removed where they stand as words of their own.
CORPORATE_TITLES = (
    "บริษัท", "บจก.", "บจก", "บมจ.", "บมจ", "ห้างหุ้นส่วนจำกัด", "หจก.", "หจก", "จำกัด (มหาชน)", "จำกัด",
    "public company limited", "company limited", "co., ltd.", "co.,ltd.", "co. ltd", "co ltd",
    "corp.", "corp", "corporation", "inc.", "inc", "incorporated", "llc", "plc", "ltd.", "ltd",
    "สาขาที่", "สาขาใหญ่", "head office", "branch",
)
PERSONAL_TITLES = (
    "นางสาว", "นาย", "นาง", "น.ส.", "ด.ช.", "ด.ญ.", "คุณ", "นพ.", "พญ.", "ดร.",
    "ศาสตราจารย์", "ศ.", "รองศาสตราจารย์", "รศ.", "ผู้ช่วยศาสตราจารย์", "ผศ.",
    "พล.ต.", "พล.อ.", "พันตรี", "พ.ต.อ.", "พ.ต.ท.", "พ.ต.ต.",
    "mr.", "mr", "mrs.", "mrs", "ms.", "ms", "miss", "dr.", "dr", "prof.", "prof", "ph.d.", "phd", "m.d.", "md",
)

# Parts glued to a Thai word; the first that fits is taken.
PERSONAL_PREFIXES = (
    "ว่าที่ร้อยตรี", "ว่าที่ร.ต.", "เด็กชาย", "เด็กหญิง", "นางสาว", "น.ส.", "น.ส", "นส.", "ด.ช.", "ด.ญ.", "ดช.", "ดญ.",
    "หม่อมหลวง", "หม่อมราชวงศ์", "ม.ล.", "ม.ร.ว.", "นาย", "นาง", "คุณ", "ดร.", "นพ.", "พญ.", "ศ.", "รศ.", "ผศ.",
)
CORPORATE_SUFFIXES = ("จำกัด(มหาชน)", "จำกัดมหาชน", "ห้างหุ้นส่วนจำกัด", "ห้างหุ้นส่วนสามัญ", "จำกัด", "บมจ", "บจก", "หจก")
CORPORATE_PREFIXES = ("ห้างหุ้นส่วนจำกัด", "ห้างหุ้นส่วนสามัญ", "บริษัท", "บมจ.", "บจก.", "หจก.", "บมจ", "บจก", "หจก")

# Dotted abbreviations and what they stand for, in the order in which they are replaced.
ABBREVIATIONS = (
    ("ว่าที่ร.ต.", "ว่าที่ร้อยตรี"), ("ม.ร.ว.", "หม่อมราชวงศ์"), ("ม.ล.", "หม่อมหลวง"), ("น.ส.", "นางสาว"), ("นส.", "นางสาว"),
    ("ด.ช.", "เด็กชาย"), ("ด.ญ.", "เด็กหญิง"), ("บมจ.", "บริษัท"), ("บจก.", "บริษัท"), ("หจก.", "ห้างหุ้นส่วนจำกัด"),
)

# Words that tell entities apart poorly.
GENERIC_WORDS = frozenset({
    "เทคโนโลยี", "นวัตกรรม", "อินโนเวชั่น", "กรุ๊ป", "โซลูชั่น", "การค้า", "บริการ", "ไทย",
    "technology", "technologies", "innovation", "innovations", "solutions", "service",
    "services", "group", "holding", "holdings", "global", "trading", "enterprise",
    "enterprises", "international", "system", "systems", "digital",
    "มหาชน", "ประเทศไทย", "ไทยแลนด์", "thailand",
})

# Names in both scripts.
BILINGUAL = (
    ("สยาม", "siam"), ("กรุงเทพ", "bangkok"), ("กสิกรไทย", "kasikornbank"), ("กสิกร", "kasikorn"), ("เอไอเอส", "ais"),
    ("เจริญโภคภัณฑ์", "charoen pokphand"), ("ซีพี", "cp"), ("สมชาย", "somchai"), ("อารียา", "areeya"),
    ("วีระชัย", "weerachai"), ("พงษ์สวัสดิ์", "pongsawat"),
)

# Aliases that names are rewritten to, word by word.
ALIASES = {
    "kbank": "kasikornbank", "กสิกรไทย": "kasikornbank", "กสิกร": "kasikornbank",
    "scb": "siam commercial bank", "ไทยพาณิชย์": "siam commercial bank",
    "bbl": "bangkok bank", "กรุงเทพ": "bangkok bank",
    "ais": "advanced info service", "เอไอเอส": "advanced info service",
    "cp": "charoen pokphand", "ซีพี": "charoen pokphand",
}

# Thai consonants by the class of their sound.
SOUND_CLASSES = {
    "k": "ก", "K": "ขฃคฅฆ", "G": "ง", "j": "จ", "C": "ฉชฌ", "s": "ซศษส", "y": "ญย", "d": "ฎด", "t": "ฏต", "T": "ฐฑฒถทธ",
    "n": "ณน", "b": "บ", "p": "ป", "P": "ผพภ", "f": "ฝฟ", "m": "ม", "r": "ร", "l": "ลฬ", "w": "ว", "h": "หฮ", "'": "อ",
}

# Romanisation of initials, vowels and finals.
INITIALS = {
    "k": "ก", "kh": "ขฃคฅฆ", "ng": "ง", "ch": "จฉชฌ", "s": "ซศษส", "y": "ญย", "d": "ฎด", "t": "ฏต", "th": "ฐฑฒถทธ", "n": "ณน",
    "b": "บ", "p": "ป", "ph": "ผพภ", "f": "ฝฟ", "m": "ม", "r": "ร", "l": "ลฬ", "w": "ว", "h": "หฮ", "rue": "ฤ", "lue": "ฦ", "": "อ",
}
VOWELS = {"a": "ะัา", "i": "ิี", "ue": "ึื", "u": "ุู", "e": "เ", "ae": "แ", "o": "โๅ", "ai": "ใไ", "am": "ำ"}
FINALS = {"k": "กขคฆ", "ng": "ง", "t": "จชซฎฏฐฑฒดตถทธศษส", "n": "ญณนรลฬ", "p": "บปพฟภ", "m": "ม", "i": "ย", "o": "ว"}
CLUSTERS = "กร กล กว ขร ขล ขว คร คล คว ตร ปร ปล ผล พร พล บร บล ฟร ฟล ทร".split()
