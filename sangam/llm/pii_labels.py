"""Labelled spans to train the finder of personal information on.

Two sources, neither of which takes part in finding: sentences made from frames with slots (the labels are exact), and
texts of the corpus with spans marked by wordings (of high precision on what they know). Any labelled spans serve."""

from __future__ import annotations

import random
import re

from sangam.llm.pii import one_form, visible

_NAME = r"[^\W\d_][^\W\d_ऀ-ः़-ॏ]*(?:[ऀ-ः़-ॏ]+[^\W\d_]*)*"
_TWO = rf"({_NAME} {_NAME})"
# Wordings around names of people, numbers of people and home addresses.
PERSON_WORDINGS = [
    rf"\b(?:ask for|contact person:|my name is|(?:missing )?(?:man|woman|boy|girl|child|person) is called|regards,|thanks,|mr\.?|mrs\.?|ms\.?|dr\.?|shri|smt\.?|signed,?) {_TWO}",
    rf"\bmera naam {_TWO} hai\b", rf"\b{_TWO} naam k[aie] \w+", rf"\bgate par (?:shri |smt\.? )?{_TWO} ji\b", rf"मेरा नाम {_TWO} ह", rf"{_TWO} नाम क[ाीे] ", rf"(?:श्री|श्रीमती|डॉ\.?) {_TWO} ", rf"\bregards\W+{_TWO}", rf"(?:सादर|धन्यवाद)\W+{_TWO}",
]
EMAIL = re.compile(r"[a-z0-9](?:[\w.+%-]*[\w+%-])?(?:\s?@|\s?\[at\]|\s?\(at\)| at (?=\S+ dot ))\s?[a-z0-9-]+(?:(?:\.|\s?\[dot\]\s?|\s?\(dot\)\s?| dot )[a-z0-9-]+)+")
PHONE = re.compile(r"(?<![\w/.+-])(?:(?:\+|00)91[\s.-]{0,2}|0(?=\d{10}\b))?(?:\(\d{3,5}\)[\s-]?\d{5,8}|\d{5}[\s.-]\d{5}|\d{3,4}[\s.-]\d{3}[\s.-]\d{4}|\d{10})(?![\w/]|[-.]\d)")
LONG_PHONE = re.compile(r"(?<![\w/.+-])(?:\+|00)91[\s.-]{0,2}\(?\d(?:[\s.()-]{0,2}\d){9}(?!\w)")
ID_NUMBER = re.compile(r"(?<![\w/.+-])(?:\d{4}[\s-]\d{4}[\s-]\d{4}|\d{12}|[a-z]{5}\d{4}[a-z]|[a-z]{3}\d{7})(?![\w/]|[-.]\d)")
_ROADS = r"(?:road|street|marg|nagar|colony|lane|apartments?|vihar|enclave|रोड|मार्ग|नगर|कॉलोनी|अपार्टमेंट|सड़क|गली)"
ADDRESS = re.compile(
    r"(?<![\w/])(?:(?:h\.\s?no\.?|house no\.?|house|flat(?: no\.?)?|plot no\.?|plot|ghar no\.?|makaan no\.?|makan no\.?|ghar number|makaan number|quarter no\.?|मकान नंबर|मकान|घर नंबर|घर संख्या|फ़्लैट(?: नंबर)?|फ्लैट(?: नंबर)?|प्लॉट(?: नंबर)?)\s?\d{1,4}(?:/[\da-z]+)?|\d{1,4}(?:/[\da-z]{1,3})?)"
    rf"(?:,? (?:sector|lane|gali|block|सेक्टर|गली|ब्लॉक|लेन) ?\d{{1,3}})?(?:,? {_NAME} {_ROADS}\b(?:,? {_NAME} {_ROADS}\b)?)"
)
_ADDRESS_CUES = re.compile(r"(?:address:|ghar ka pata|parents stay at|the house is|deliver the medicine to|dawai|घर का पता|दवा)\s*$")


def weak_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by wordings: labels for training."""
    t, stood = visible(one_form(text))
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]
    for pattern, kind in ((ID_NUMBER, "id_number"), (LONG_PHONE, "phone"), (PHONE, "phone")):
        out += [(m.start(), m.end(), kind) for m in pattern.finditer(t)]
    out += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(t) if not m.group()[0].isdigit() or _ADDRESS_CUES.search(t[: m.start()])]
    for p in PERSON_WORDINGS:
        out += [(*m.span(1), "person") for m in re.finditer(p, t)]
    out.sort(key=lambda s: (s[0], -s[1]))
    kept: list[tuple[int, int, str]] = []
    for s in out:
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept if stood is None else [(stood[a], stood[b - 1] + 1, k) for a, b, k in kept]


# Frames of generated sentences, one slot each at most: {e}mail, {t}elephone, {i}d number, {a}ddress, {p}erson, {s}ite.
# {n} and {d} are numbers and digits that belong to nobody. They are written for training, not taken from any table.
FRAMES = {
    "en": """
you can write to {e} for the list | mail {e} before noon | the complaint came from {e} | copy {e} on every reply | reach us by mail at {e} | {e} has the photographs | her inbox is {e} | send the bills to {e} please
dial {t} for my son | you may ring {t} tonight | whatsapp {t} with the location | my mobile: {t} | the driver answers on {t} | text {t} once you arrive | {t} is the number of my aunt | phone number {t} is switched off | call {t} | reach me on {t} after six
aadhaar {i} was verified | the voter card says {i} | pan {i} is enclosed | her identity number is {i} | card {i} belongs to the patient | quote {i} when you claim | document no. {i} was lost | identity proof {i} was copied
we live at {a} | the old couple is at {a} | please come to {a} | bring the wheelchair to {a} | residence: {a} | the patient waits at {a} | address is {a} | food should reach {a} by night
please ask for {p} when you come | {p} is missing since morning | mr {p} will open the shed | i am {p} | this is {p} speaking | contact {p} for the keys | dr {p} is on duty | yours, {p} | regards, {p} | reported by {p} | the boy is called {p} | mrs {p} cannot walk | met {p} at the camp | name of the caller: {p} | my wife {p} is inside
water stands near {s} petrol pump | a wall fell behind {s} stadium | the clinic at {s} dairy is shut | we are writing from {s} | the spot is {s} | road to {s} is open | bus stopped at {s} crossing | between {s} cinema and {s} school a pole bent
ticket {d} was closed | train {d} is late | meter shows {d} | call 112 for help | helpline 1070 is busy | truck up {n} ab {d} has sand | batch {d} of chlorine expired | rs {d} was announced | gauge at 28.{d}, 79.{d} is steady | {n} people wait on the roof | about {n} blankets are needed | boat no. {n} leaves at 07:{n} | sector {n} has no power | ward {n} office is closed | lane {n} is dry | bus route {n} is cut | order {d} was delivered
""",
    "hi-Latn": """
{e} par likh dijiye | mail id {e} hai | photo {e} par bhejiye | uska email {e} tha | jawab {e} par aayega
{t} par baat kijiye | uncle ka phone {t} hai | {t} mila lo | mera mobile {t} hai | bhai ka number {t} likh lo | raat ko {t} par call karna
pehchan number {i} hai | aadhaar {i} jama hua | card {i} kho gaya | pan card {i} hai | kaagaz par {i} likha hai
hamara pata {a} hai | mareez {a} mein hai | khana {a} par bhejo | makaan ka pata {a} hai | dawai {a} tak pahunchao
{p} kal se laapata hai | mujhe {p} kehte hain | shri {p} se baat karna | {p} ji gate par milenge | bacche ka naam {p} hai | main {p} bol raha hoon | smt {p} bimar hain | bhejne wale ka naam {p} hai
{s} pump ke paas pani hai | {s} bazaar mein bheed hai | jagah {s} hai | {s} tak sadak khuli hai | {s} dairy aur {s} school ke beech pani hai
ticket {d} band hua | gaadi {d} der se hai | meter mein {d} dikha | 112 milao | truck up {n} ab {d} khada hai | rs {d} milenge | {n} log chhat par hain | {n} kambal chahiye | sector {n} mein bijli nahi
""",
    "hi": """
{e} पर लिखिए | ईमेल {e} पर भेजें | उनका मेल {e} था | फ़ोटो {e} पर दें
{t} पर बात कीजिए | चाचा का फ़ोन {t} है | मोबाइल {t} बंद है | मेरा मोबाइल {t} है | रात में {t} मिलाइए
पहचान संख्या {i} है | आधार {i} जमा हुआ | कार्ड {i} खो गया | पत्र पर {i} लिखा है
हमारा पता {a} है | मरीज़ {a} में है | खाना {a} पर भेजिए | दवाई {a} तक पहुँचाइए
{p} कल से लापता है | मुझे {p} कहते हैं | श्री {p} से बात कीजिए | {p} जी द्वार पर मिलेंगे | बच्चे का नाम {p} है | मैं {p} बोल रहा हूँ | श्रीमती {p} बीमार हैं | भेजने वाले का नाम {p} है
{s} पंप के पास पानी है | {s} बाज़ार में भीड़ है | जगह {s} है | {s} तक सड़क खुली है | {s} डेयरी और {s} स्कूल के बीच पानी है
टिकट {d} बंद हुआ | गाड़ी {d} देर से है | मीटर में {d} दिखा | 112 मिलाइए | {n} लोग छत पर हैं | {n} कंबल चाहिए | रु {d} मिलेंगे
""",
}
_SYLLABLES = {"latin": ("b d g k l m n p r s sh t v bh dh kh ch j h y".split(), "a e i o u aa ee".split(), ["", "n", "r", "l", "sh", "m"]), "deva": (list("बदगकलमनपरसशतवभधखचजह"), ["", "ा", "ि", "ी", "ु", "ू", "े", "ो"], ["", "न", "र", "ल", "म"])}
_STREETS = {"en": ["road", "street", "lane", "colony", "nagar", "marg", "apartments", "vihar", "enclave"], "hi-Latn": ["road", "marg", "nagar", "colony", "gali"], "hi": ["रोड", "मार्ग", "नगर", "कॉलोनी", "गली"]}
_HOUSES = {"en": ["h.no. {n}", "house no. {n}", "house {n}", "flat {n}", "plot no. {n}", "{n}/{m}", "{n}"], "hi-Latn": ["makaan no. {n}", "ghar no. {n}", "{n}/{m}", "{n}"], "hi": ["मकान नंबर {n}", "घर नंबर {n}", "फ़्लैट {n}", "{n}/{m}"]}
_BLOCKS = {"en": ["sector {m}", "lane {m}", "block {m}"], "hi-Latn": ["gali {m}", "sector {m}"], "hi": ["गली {m}", "सेक्टर {m}"]}


def frames(language: str) -> list[str]:
    return [f.strip() for line in FRAMES[language].strip().splitlines() for f in line.split("|")]


def _word(r: random.Random, script: str) -> str:
    onset, vowel, coda = _SYLLABLES[script]
    return "".join(r.choice(onset) + r.choice(vowel) for _ in range(r.randint(2, 3))) + r.choice(coda)


def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _phone(r: random.Random) -> str:
    x = _digits(r, 10)
    body = r.choice([x, x[:5] + "-" + x[5:], x[:5] + " " + x[5:], x[:3] + "." + x[3:6] + "." + x[6:], x[:4] + " " + x[4:7] + " " + x[7:], f"({x[:4]}) {x[4:]}"])
    return body if body[0] == "(" else r.choice(["", "", "", "+91 ", "+91-", "+91", "0091"]) + body


def _email(r: random.Random) -> str:
    local = r.choice(["{0}", "{0}.{1}", "{0}_{1}", "{0}{2}", "{0}+{1}"]).format(_word(r, "latin"), _word(r, "latin"), r.randint(1, 999))
    host = [_word(r, "latin"), r.choice(["com", "org", "net", "example", "test"])]
    host[:0] = r.choice([[], [r.choice(["mail", "post", "inbox"])]])
    at, dot = r.choice([("@", ".")] * 3 + [("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot ")])
    return local + at + dot.join(host)


def _id(r: random.Random) -> str:
    letters = lambda n: "".join(r.choice("abcdefghjklmnpqrstuvwxyz") for _ in range(n))
    x = _digits(r, 12)
    return r.choice([x, f"{x[:4]} {x[4:8]} {x[8:]}", f"{x[:4]}-{x[4:8]}-{x[8:]}", letters(5) + x[:4] + letters(1), letters(3) + x[:7]])


def _address(r: random.Random, language: str, script: str) -> str:
    n, m = r.randint(1, 399), r.randint(1, 30)
    parts = [r.choice(_HOUSES[language]).format(n=n, m=m)]
    if r.random() < 0.4:
        parts.append(r.choice(_BLOCKS[language]).format(m=m))
    parts += [f"{_word(r, script)} {r.choice(_STREETS[language])}" for _ in range(r.choice([1, 1, 2]))]
    return (r.choice([", ", ", ", " "])).join(parts)


def invented(n: int, devanagari: bool, seed: int = 29) -> list[str]:
    """n made-up words."""
    r = random.Random(seed)
    return [_word(r, "deva" if devanagari else "latin") for _ in range(n)]


def generate(n: int, seed: int = 17, keep=lambda frame: True) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """n sentences with exact spans; a fifth of the names are single words. keep chooses frames (to hold some out)."""
    r = random.Random(seed)
    pools = {k: [f for f in frames(k) if keep(f)] for k in FRAMES}
    slots = {"e": "email", "t": "phone", "i": "id_number", "a": "address", "p": "person"}
    kinds = {k: {s: [f for f in pool if f"{{{s}}}" in f] for s in [*slots, ""]} for k, pool in pools.items()}
    for k, pool in pools.items():
        kinds[k][""] = [f for f in pool if not any(f"{{{s}}}" in f for s in slots)]
    out = []
    while len(out) < n:
        language = r.choice(list(FRAMES))
        pool = kinds[language][r.choice(["e", "t", "i", "a", "p", "p", "p", "", ""])]
        if not pool:
            continue
        script = "deva" if language == "hi" else "latin"

        def name() -> str:
            return _word(r, script)

        text, spans, frame = "", [], r.choice(pool)
        if "{p}" not in frame and "{" in frame and r.random() < 0.3:  # what has a form of its own is known among words never met too
            frame = " ".join(w if "{" in w or r.random() < 0.4 else _word(r, script) for w in frame.split())
        for part in re.split(r"(\{\w\})", frame):
            fill = {
                "{e}": lambda: _email(r), "{t}": lambda: _phone(r), "{i}": lambda: _id(r), "{a}": lambda: _address(r, language, script), "{s}": lambda: _word(r, script),
                "{p}": lambda: name() if r.random() < 0.2 else f"{name()} {name()}", "{n}": lambda: str(r.randint(2, 99)), "{d}": lambda: _digits(r, r.randint(4, 8)),
            }.get(part)
            got = fill() if fill else part
            if part[1:2] in slots and fill:
                spans.append((len(text), len(text) + len(got), slots[part[1]]))
            text += got
        out.append((text + r.choice([".", "", ".", "।" if language == "hi" else "."]), spans))
    return out
