"""Personal items in free text, by a skip-chain conditional random field.

Every token gets one of O and the begin and inside of five kinds. The chain's scores come from the forms of the
token and its neighbours, from whether a public vocabulary knows the word, and from patterns that propose e-mails,
numbers and addresses. Tokens of a text that repeat or resemble each other share potentials: where a pass over the
chain labels one of them, they send each other messages along these skip edges, and the pass is repeated. Spans that
agree with a pattern are settled to the pattern's exact ends; the field may also label spans that no pattern proposes.

The weights are fitted on invented texts (`invented`; `python -m tarn.llm.pii` writes them to WEIGHTS). Nothing depends
on the other texts of the input, so a text is masked alike in every table.
"""

from __future__ import annotations

import hashlib
import os
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.bpe import VOCABULARY, load_ranks
from tarn.session import ship_package

KINDS = ("person", "email", "phone", "id_number", "address")
STATES = ["O"] + [f"{p}-{k}" for k in KINDS for p in "BI"]
REACH = 4
#: Weight of a skip edge, rounds of messages, and letters two names must share to be alike.
SKIP_WEIGHT, ROUNDS, ALIKE = 3.0, 2, 4
#: Token forms a worker remembers, and tokens that are decoded at once.
REMEMBERED, BATCH_TOKENS = 60_000, 200_000
#: The fitted weights.
WEIGHTS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "pii_weights.npz")
#: Texts and rounds of the fit.
FIT_TEXTS, FIT_ROUNDS = 5_000, 10

TOKEN = regex.compile(r"[\p{L}\p{M}]+|\d+|\S")

_AT = r"(?:\s?@\s?|\s?[\[(]\s?at\s?[\])]\s?|\sat\s)"
_DOT = r"(?:\.|\s?[\[(]\s?dot\s?[\])]\s?|\sdot\s)"
PROPOSALS = {
    "email": re.compile(rf"(?<![\w.+-])[a-z0-9][a-z0-9._+%-]*{_AT}[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9][a-z0-9-]*)*{_DOT}[a-z]{{2,}}(?![a-z0-9-])", re.I),
    "phone": re.compile(r"(?<![\w.,/+-])(?:\+?\(?91\)?[\s.-]?|0)?(?:\(\d{2,5}\)[\s-]?\d{3,4}[\s-]?\d{3,4}|\d{5}[\s-]\d{5}|\d{10}|\d{3}[-. ]\d{3}[-. ]\d{4}|\d{4}[-. ]\d{3}[-. ]\d{3}|\d{2}(?:[ -]\d{2}){4})(?!\w|[.,/-]\d)"),
    "pan": re.compile(r"(?<![\w/-])[a-z]{5}[\s-]?\d{4}[\s-]?[a-z](?![\w/])", re.I),
    "national": re.compile(r"(?<![\w.,/+-])\d{4}([\s.-]?)\d{4}\1\d{4}(?!\w|[.,/-]\d)"),
    "passport": re.compile(r"(?<![\w/-])[a-z][\s-]?\d{7}(?!\w|[./-]\d)", re.I),
    "licence": re.compile(r"(?<![\w/-])[a-z]{2}[\s-]?\d{2}[\s-]?\d{11}(?!\w|[./-]\d)", re.I),
    "address": re.compile(
        r"(?<![\w.,/-])(?:(?:flat|plot|house|door|apt|apartment|unit|villa|bungalow|quarter|room|h\s?\.\s?no|d\s?\.\s?no)\b\.?\s*(?:no\b\.?)?\s*#?\s*|#\s*)?\d{1,4}(?:/\d{1,3})?[a-z]?\b,?\s+"
        r"(?:[a-z][a-z'.]*(?:\s+[a-z0-9][a-z0-9'.]*){0,3},\s*){0,3}?"
        r"[a-z][a-z'.]*(?:\s+[a-z][a-z'.]*){0,3}?\s+(?:street|road|lane|marg|nagar|colony|avenue|rd|st|ln|gali|chowk|path|circle|layout)\b\.?,\s*"
        r"(?-i:[A-Z][A-Za-z]+(?:\s+(?:East|West|North|South|EAST|WEST|NORTH|SOUTH))?|[a-z]+)(?:\s*[-–,]?\s*\d{3}\s?\d{3}(?!\d))?",
        re.I,
    ),
}
KIND_OF = {"email": "email", "phone": "phone", "pan": "id_number", "national": "id_number", "passport": "id_number", "licence": "id_number", "address": "address"}
_SEVEN_DIGITS = re.compile(r"(?:\d[\s.()-]{0,2}){6}\d")
_MAIL_SIGN = re.compile(r"@|[\[(\s]at[\])\s]|[\[(]\s?at\s?[\])]")
_STREET_WORD = re.compile(r"\s(?:street|road|lane|marg|nagar|colony|avenue|rd|st|ln|gali|chowk|path|circle|layout)\b")
_PAN_END = re.compile(r"\d{4}[\s-]?[A-Za-z]")
_DIGIT_AT = re.compile(r"[\d@]|\bat\b|\[at|\(at", re.I)

# Words that open or follow the kinds of places in an address.
STREETS = ("street", "road", "lane", "marg", "nagar", "colony", "rd", "st", "block", "sector", "floor", "cross", "heights", "apartments", "towers", "residency", "society", "layout", "avenue", "circle", "chowk", "gali")


# Titles that are no part of a name.
TITLES = frozenset("mr mrs ms miss dr prof shri smt sri kumari mx er adv sir madam".split())
# Words that stand in no name.
NO_NAMES = frozenset("the a an in of at on to for from by and or is are was were be has have had with not no".split())
# Words that close the name of a company, scheme or index.
CLOSING = frozenset("fund funds plan trust scheme index composite bank ltd limited amc cap tr tri".split())


def tokenised(text: str) -> tuple[list[str], list[int], list[int]]:
    spans = [m.span() for m in TOKEN.finditer(text)]
    return [text[a:b] for a, b in spans], [a for a, _ in spans], [b for _, b in spans]


def proposals(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of every proposal."""
    if not _DIGIT_AT.search(text):
        return []
    low = text.lower()
    # what each pattern needs at least: seven digits in a row but for separators, a mail sign, a street's word
    needs = {"email": bool(_MAIL_SIGN.search(low)), "address": bool(_STREET_WORD.search(low)), "pan": bool(_PAN_END.search(text))}
    digits = bool(_SEVEN_DIGITS.search(text))
    return [(m.start(), m.end(), name) for name, p in PROPOSALS.items() if needs.get(name, digits) for m in p.finditer(text)]


# ---- invented training texts -------------------------------------------------------------------------------------

_SYLLABLES = "ba be bo da de du fa fi ga go ha hi ja jo ka ke ki la le lo ma me mu na ni no pa pe ra re ro sa se so ta te to va vi ya yo za".split()
_TAILS = "rov lin mand dell var nath kars tian gupt shek wen dose barg hill mont".split()

# Invented carriers of the training texts, one in a line; {} stands for the item.
_TO_NAME = """Sincerely, {}
Kind regards, {}.
Regards {}
Best wishes, {}
Many thanks, {}.
With love, {}
Yours truly, {}
- {}
{} here.
{} speaking,
I am {}, and
I am {} and
I'm {}.
My name is {}.
my name is {}, so
mera naam {} hai,
main {} hoon.
This is {} calling.
This is {} from the shop,
Name: {}
Name - {},
Owner: {};
Applicant: {}.
Nominee: {}.
Guardian: {}
Payee: {}.
Tenant: {}
Witness: {};
Guest - {},
Mr. {} rang twice.
Mr {} is late.
Mrs. {} wrote:
Ms {} left.
Ms. {} agrees:
Dr. {} was kind.
Dr {} read the letter, but
Prof. {} teaches there.
Shri {} bought it.
Smt. {} lives here.
my aunt {} thinks so:
my uncle {} came too.
my sister {} likes it,
my wife {} drives.
my husband {} is away,
my father {} cooks;
my mother {} asked:
our tenant {} pays
my colleague {} wants to know:
please ask {} about it.
Please thank {} for me.
Please talk to {} first,
speak with {} on Friday.
call {} later.
I share the flat with {};
I went there with {}.
We travel together with {},
The key is with {}.
met {} at noon.
on behalf of {},
signed by {} in ink.
written by {} last night.
{} asked me this:
{} wants to know:
{} told us.
{} said no,
Attention {},
care of {}
heir: {}.
Contact person {}."""
#: Carriers of a name that say little by themselves.
_WEAK = """{} came later.
then {} left the room.
and {} as well.
After that {} paid.
so {} waits
with {} or without."""
_TO_ITEM = {
    "phone": "Ring me at {}.|My mobile is {},|mobile {};|cell: {} -|Tel. {}|telephone {},|text {} after six.|The call from {} was cut.|no message came to {}.|landline {}|dial {} please.|fax {};|number: {}.|you can get me on {} at night,|({})|{} is where I can be reached.|Mob: {} /|WA {}:|so {} it is.|{} again|of {} too,|WhatsApp {},|whatsapp {}:|Ph. {} -|Ph: {} /|ping {}",
    "id_number": "Tax id {}.|tax number: {};|PAN {} is wrong.|pan card {},|My pan is {} -|Aadhaar no {}.|Aadhaar {} matches.|aadhaar {} was seen,|aadhaar: {};|UIDAI {} please check.|National id {},|identity card {}.|Passport {} is lost.|passport number: {};|travel papers {} were stamped,|licence no. {}.|driving permit {} has lapsed.|DL {};|KYC with {} failed.|my card {} was copied.|({})|so {} it is.|the copy of {} is here.|{} again|of {} too,|the number on my card is {}.|proof: {}|I showed {} at the gate,|I handed in {} as proof,|verified against {} -",
    "email": "Mail {}.|my mail is {},|e-mail: {};|send the file to {} please.|answer to {} -|({})|so {} it is.|{} again|of {} too,|The address {} bounced.|you find me at {} too,|account {}|login {};|inbox {}|cc {} please,|contact {} for more.",
    "address": "We live at {}.|Ship it to {}.|Send the box to {}.|post it to {},|The parcel went to {} instead.|I moved out of {} in spring;|moved to {}.|home: {};|residence {}.|my new home is {},|come to {} at noon.|The house at {} is sold.|delivered to {}.|Address: {}|so {} it is.|{} again|of {} too,|billing address {} -",
}
# Invented sentences without an item; names in braces are filled in.
_PLAIN = """What does {f} cost?
How much is the fee of {f}?
Is {f} better than {f}?
Should I buy {f} now?
Will {f} beat {i}?
{f} and {f} differ.
{f} pays {p}% since {y}.
The report of {f} came on {n} May {y}.
Does {f} take ₹{a} a week?
Does {c} need Rs {a}?
Tell me more about {f}
{c} opened a shop in {t}.
{c} wrote to us on {n} April {y}.
{c} is closed on Sunday.
Ask the help desk at {c}.
A note by {c} is out.
The {w} at {c} was polite.
Is {c} a good bank?
{c} Asset Management sold it.
{c} House is empty.
{i} fell by {p}%.
{i} rose in {y}.
{i} ({p}%)
It follows {i}.
Measured against {i}, it lost.
Index: {i}
INDEX: {I}
{t} office, desk {n}.
The {t} office opens at {n}:30.
From {t} to {t} by train.
{t}, {t} and {t} are far.
A customer from {t} waits.
Rain in {t} again.
Ticket {a3}-{a3}-{n} was closed.
Receipt {a3}-{a4}-{n} is lost.
Parcel no. {d5}{a3} is late.
Order {d5}{a4} was sent.
Invoice {d5}/{n} is due.
Folder {d5}{a4}/{n} is full.
Account {d5}{d5} was opened.
Reference {d5}{d5} is noted.
Notice AB/CD/{a3}/{y} is old.
Form {n}C is needed.
Batch {y}-{n}-{a4} of {n} June {y} failed.
Code XY{a3}K{d5} is printed there.
Product code ZQ{n}F{d5}.
Version {n}.{n}.{a3}.{n} is slow.
The value {d5}.{d5} is odd.
The sum is {lakh} rupees.
I own {lakh} shares.
Worth ₹{lakh} today.
Size: {lakh} crore
Price ₹{a3}.{a4} on {n} July {y}.
Open {n}:30-{n}:45 only.
The gate shuts at {n}:15 pm.
Step {n} of {a3} hangs at {p}%.
Read the page of @{h} first.
Between {y} and {y} little changed.
Since {n} March {y} the {w} waits.
On {n} August {y}, the {w} printed {a3} pages.
Hello all.
Hi there,
Dear all,
Good morning.
Thank you so much!
pls reply soon
Is it free?
Who can sign the form?
How can I get the paper?
When will it end?
kya yeh sahi hai?
mera paisa kab aayega?
yeh {n} din mein ho jata hai kya?
meri beti ka khata band ho gaya kya?
office mein koi baat nahi karta kya?
naya grahak bina form ke aage jata hai kya?
{p}% se zyada kharch lagta hai kya?
The {w} reads the old letter to the {w} in {t}.
A {w} checks the list of {n} names by {n}:45 pm.
While the {w} is in {t}, nobody signs.
If the {w} agrees, a {w} counts {a3} boxes.
Under the new rule, the {w} keeps {p}% in cash.
The {w} quotes {p}% for {f}.
Someone leaving {f} sold {n} units.
A holder of {f} asks about {i}.
The {w} of {f} paid ₹{a}.
| {f} | {p}% | {lakh} |
# {k}
## {k} Notes
Type: {k}
TYPE: {K}
Risk: {K}
GRADE: {K}
Grade - {K}
Shade: {C} {w}
level: {k} to {k}
{f}: {p}%
Period: {n} months
nothing
Not yet known
In the first {n} days, {w} and {w} wait.
The footer shows a date.
The {w}'s {u} counts {n} boxes.
A {w}'s {u} is late.
After a late {u}, the {w} waits.
Nobody reads the old {u} list.
The {u} {w} sends a {u} to the {w}.
with {u} {u} as the next block.
on {u} and {u} alone.
Each {u} has {n} {u} parts.
The {w} {u}s the {u} for {y}.
{w} ka {u} {u} hai kya?
yeh {u} {u} karta hai kya?
naya {u} {u} mein {u} hai kya?
{U} {U}{n}K{d5}.
{U} NO {U}{a3}L{d5}.
{U}: {U} {U}
{C}: not {u}
{C} {C} Notes
What is the {U} of {f}?
The {U} rule of {y} holds.
Since {C} left {t}, the {w} waits.
हर महीने दुकान बंद रहती है और फिर खुलती है।
₹{a} या अधिक पर {w} नया कागज़ देता है।
पुराना कागज़ {n} दिन में मिलता है, {p}% कम।
Together with {f}, the {w} waits.
Along with {i}, it fell.
Next to {f}, {f} looks small.
The yearly list of {f} is out.
The old price paper of {f} since {y}.
A copy of {f} was sent to {t}, with {i} as its mark.
Joined with {f} in {y}, it grew.
with {f} and with {i} beside it
The mark, {i}, fell again.
Before noon, {f} paid the {w}.
{f} sends the {u} to the {w}.
Some {w}s {u} the {u} of {f}.
A {w}'s {u} {u}s the old list for {t}.
The {w}'s {u} reads it.
The {w} sends the {u} {u} without a word.
aapki {u} {w} se milti hai kya?
aap ka {u} {w} kahan hai?
direct {u} {w} free hai kya?
Least sum: {U} {a}00
{U} {lakh} only
{p}/{a3}.{n}/{a3}.{p}/{n}.{n}/{a3}.{n}
Why so slow?"""


def _lines(text: str) -> list[str]:
    return text.split("\n")


class Maker:
    """Invented names, addresses, mail addresses and numbers."""

    def __init__(self, seed: int, vocabulary: list[str] = ()):
        self.r = random.Random(seed)
        self.vocabulary = list(vocabulary)
        self.houses = [self.word(2, 3).capitalize() + self.r.choice(("moor", "vale", "bank", "field", "")) for _ in range(60)]
        self.towns = [self.word(2, 3).capitalize() + self.r.choice(("pur", "gaon", "nagar", "", "")) for _ in range(60)] + [self.word(2, 3).capitalize() + " " + x for x in ("East", "West", "North", "South")]

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def word(self, least: int, most: int) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(least, most)))

    def styled(self, text: str) -> str:
        return self.r.choices((text, text.upper(), text.lower()), (8, 2, 1.5))[0]

    def person(self) -> str:
        r = self.r
        given, family = self.word(2, 3).capitalize(), (self.word(1, 2) + r.choice(_TAILS)).capitalize()
        if self.vocabulary and r.random() < 0.12:  # names that are words of the language
            family = r.choice(self.vocabulary).capitalize()
        middle = f" {r.choice('ABDKLMNPRSTV')}." if r.random() < 0.2 else ""
        return self.styled(f"{given}{middle} {family}")

    def email(self) -> str:
        r = self.r
        user = self.word(2, 4) + r.choice((".", "_", "-", "+", "")) + self.word(1, 3) + r.choice(("", "", self.digits(2)))
        parts = [*([self.word(1, 2)] if r.random() < 0.7 else []), self.word(2, 3), r.choice(("example", "test", "invalid", "com", "in", "org"))]
        at, dot = r.choices((("@", "."), (" @ ", "."), (" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", " [dot] ")), (6, 1.5, 1, 1, 0.5, 0.5))[0]
        return self.styled(user + at + dot.join(parts))

    def phone(self) -> str:
        r, d = self.r, self.digits
        lead = r.choice("6789")
        body = r.choice((lead + d(9), lead + d(4) + " " + d(5), lead + d(2) + "-" + d(3) + "-" + d(4), lead + d(3) + "." + d(3) + "." + d(3), " ".join((lead + d(1), d(2), d(2), d(2), d(2))), f"(0{d(2)}) {d(4)} {d(4)}", f"({lead}{d(3)}) {d(3)}-{d(3)}"))
        before = "" if body.startswith("(0") else r.choice(("", "", "+91 ", "+91-", "91 ", "0"))
        if before == "0" and len(body) != 10:
            before = ""
        return before + body

    def odd_phone(self) -> str:
        """A form that no pattern proposes."""
        d = self.digits
        return self.r.choice((f"{d(2)}-{d(4)}-{d(2)}-{d(2)}", f"{d(3)}/{d(3)}/{d(4)}", f"+{d(2)} {d(2)} {d(3)} {d(2)} {d(2)}", f"{d(4)}-{d(2)}-{d(2)}-{d(2)}"))

    def id_number(self) -> str:
        r, d = self.r, self.digits
        letters = lambda n: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))
        gap = r.choice(("", "", "", " ", "-", "."))
        x = r.choice((letters(5) + d(4) + letters(1), f"{letters(5)} {d(4)} {letters(1)}", gap.join((d(4), d(4), d(4))), letters(1) + d(7), f"{letters(1)} {d(7)}", f"{letters(2)}{d(2)} {d(11)}", f"{letters(2)}{d(2)}-{d(11)}", letters(2) + d(13)))
        return x.lower() if r.random() < 0.15 else x

    def address(self) -> str:
        r = self.r
        number = r.choice((self.digits(3), self.digits(2), self.digits(3) + "/2", self.digits(3) + "B"))
        start = r.choice(("Flat ", "Flat No. ", "Plot ", "House ", "House No ", "Door No. ", "Apt ", "H.No. ", "#", "", ""))
        street = " ".join((*(self.word(2, 3).capitalize() for _ in range(r.randint(1, 2))), r.choice(STREETS[:8]).capitalize()))
        extra = r.choice((["Block C"], ["Ground Floor"], ["Sector 14"], [self.word(2, 3).capitalize() + " Towers"], [self.word(2, 3).capitalize() + " Apartments"], [], [], []))
        pin = r.choice(("", " " + self.digits(6), " - " + self.digits(6), f" {self.digits(3)} {self.digits(3)}"))
        return f"{start}{number}{r.choice((', ', ' ')) if not extra else ', '}{', '.join([*extra, street])}, {r.choice(self.towns)}{pin}"

    def plain(self) -> str:
        r, d = self.r, self.digits
        out = r.choice(_lines(_PLAIN))
        kinds = ("Equity", "Bond", "Large Value", "Cash", "Mixed Asset", "Growth", "Short Term", "Small Company", "Gold", "Focus")
        unknown = lambda: self.word(2, 3) + r.choice(("", "", r.choice(_TAILS)))
        index = lambda: r.choice((f"{r.choice(self.houses)} {r.choice((20, 75, 300))}", f"{r.choice(self.houses)} {r.choice((40, 300))} TR", f"{r.choice(self.houses)} {r.choice(('Bond', 'Cash', 'Composite', 'Small', 'Low Risk'))} Index", f"{r.choice(self.houses)} {r.choice(('Mixed 40+60', 'Low Risk 20', 'Value 75'))} {r.choice(('Index', 'TR'))}", f"{r.choice(self.houses)} {r.choice(('Cash Index B', 'Bond Composite', '20 (Net Index)'))}", f"{r.choice(self.houses)} {unknown().capitalize()} {r.choice(('Composite', 'Index', '75 TR', '(Net Index)'))}"))
        fund = lambda: f"{r.choice(self.houses)} {r.choice(('', '', r.choice(('Lane ', 'Hill '))))}{r.choice((r.choice(kinds), r.choice(kinds), self.styled(unknown().capitalize()), unknown().capitalize() + ' ' + r.choice(('Cap', 'Asset', 'Term'))))} {r.choice(('Fund', 'Fund', 'Fund', 'Plan', 'Trust', ''))}".strip()
        values = {"{u}": unknown, "{U}": lambda: unknown()[: r.randint(3, 6)].upper(), "{C}": lambda: unknown().capitalize(), "{f}": fund, "{c}": lambda: r.choice(self.houses) + r.choice(("", "", " Lane", " Bank", " Capital")), "{h}": lambda: r.choice(self.houses), "{t}": lambda: r.choice(self.towns), "{i}": index, "{I}": lambda: index().upper(), "{a}": lambda: r.choice((d(3), "1,500", "72,250", "40,000")), "{a3}": lambda: d(3), "{a4}": lambda: d(4), "{d5}": lambda: r.choice("123456789") + d(4), "{n}": lambda: str(r.randint(1, 30)), "{y}": lambda: str(r.randint(2005, 2027)), "{p}": lambda: f"{r.randint(0, 9)}.{d(2)}", "{lakh}": lambda: r.choice(("23,45,678.90", "2,34,56,789", "3,21,609.18", "71,408.55")), "{k}": lambda: r.choice(("High", "Very Low", "Moderate", *kinds)), "{K}": lambda: r.choice(("VERY LOW", "HIGH", "MIXED ASSET", "FAIRLY HIGH", "RATHER LOW", "Rather High", "MEDIUM TO HIGH")), "{w}": lambda: r.choice(("baker", "teacher", "printer", "driver", "gardener", "owner", "old plan", "reader", "tailor", "trust company", "tax paper", "visitor"))}
        for key, value in values.items():
            while key in out:
                out = out.replace(key, value(), 1)
        return out


def invented(count: int, seed: int = 7, vocabulary: list[str] = ()) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their personal items, put together from carriers and invented names and numbers."""
    m = Maker(seed, vocabulary)
    r = m.r
    texts = []
    for _ in range(count):
        text, spans, known = "", [], []

        def put(carrier: str, item: str, kind: str) -> None:
            nonlocal text
            before, after = carrier.split("{}")
            spans.append((len(text) + len(before), len(text) + len(before) + len(item), kind))
            text += before + item + after

        if r.random() < 0.25:
            text = r.choice(("Hey, ", "Good evening, ", "Dear team, ", "Hello all. ", "please reply! ", "Hi, "))
        for _ in range(r.randint(1, 5)):
            x = r.random()
            if x < 0.58:
                text += m.plain()
            elif x < 0.74:
                again = known and r.random() < 0.3
                item = r.choice(known) if again else m.person()
                if again or r.random() < 0.06:
                    put(r.choice(_lines(_WEAK)), item, "person")
                else:
                    carrier = r.choice(_lines(_TO_NAME))
                    put(carrier if r.random() < 0.8 else carrier.lower().replace("{}", "{}"), item, "person")
                known.append(item)
            else:
                kind = r.choice(("phone", "id_number", "email", "address"))
                item = m.odd_phone() if kind == "phone" and r.random() < 0.12 else getattr(m, kind)()
                put(r.choice(_TO_ITEM[kind].split("|")), item, kind)
            text += r.choice((" ", " ", " ", "\n"))
        texts.append((text, spans))
    return texts


@lru_cache(maxsize=2)
def vocabulary(path: str = VOCABULARY) -> frozenset:
    """The lower-case words that are single entries of a public vocabulary file."""
    found = set()
    for token in load_ranks(path):
        word = token[1:].decode("utf-8", "replace")
        if token[:1] == b" " and len(word) > 1 and word.isalpha():
            found.add(word.lower())
    return frozenset(found)


# ---- the field -----------------------------------------------------------------------------------------------------


def shape(token: str) -> str:
    if token.isdigit():
        return f"d{min(len(token), 12)}"
    if token.isalpha():
        if len(token) == 1:
            return "x1" if token.islower() else "X1"
        script = "" if token.isascii() else "?"
        return script + ("xx" if token.islower() else "XX" if token.isupper() else "Xx" if token[0].isupper() and token[1:].islower() else "xX")
    return token if token.isascii() else "?xx" if token[0].isalpha() else "sign"


def is_known(low: str, words: frozenset) -> bool:
    """The word, or its stem without an ending, stands in the vocabulary."""
    if low in words:
        return True
    for ending in ("s", "es", "ed", "d", "ing", "ly", "er"):
        if low.endswith(ending) and len(low) - len(ending) > 2 and low[: -len(ending)] in words:
            return True
    return low.endswith("ies") and low[:-3] + "y" in words or low.endswith(("ing", "ed")) and low.removesuffix("ing").removesuffix("ed") + "e" in words


def features(token: str, lexicon: frozenset, words: frozenset) -> list[str]:
    """The features of a token's form; the last of an unknown word is `new:` and its shape."""
    out = ["s:" + shape(token)]
    if token.isalpha():
        low = token.lower()
        if low in lexicon:
            out.append("w:" + low)
        if low in STREETS:
            out.append("street")
        if low in TITLES:
            out.append("title")
        if len(token) > 1:
            out.append(f"known:{shape(token)}" if low in lexicon or is_known(low, words) else f"new:{shape(token)}")
    elif token.isdigit():
        out.append("digits" if len(token) < 6 else "long digits")
    elif not token[0].isalpha():
        out.append("w:" + token)
    return out


FLAGS = [f"{p}-{name}" for name in PROPOSALS for p in "BI"]


def flag_columns(text: str, starts: list[int], ends: list[int]) -> np.ndarray:
    """The proposals that cover each token, as one column per FLAGS entry."""
    out = np.zeros((len(starts), len(FLAGS)), np.float32)
    for a, b, name in proposals(text):
        first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
        if first < last:
            k = 2 * list(PROPOSALS).index(name)
            out[first, k] = 1
            out[first + 1 : last, k + 1] = 1
    return out


def marginals(score: np.ndarray, move: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(marginals, pair sums) of chains padded to one length: score is (texts, tokens, states). Scaled sums and products."""
    n, t, s = score.shape
    psi = np.exp(score - score.max(2, keepdims=True))
    trans = np.exp(move)
    forward, back = np.empty_like(psi), np.ones_like(psi)
    forward[:, 0] = psi[:, 0] / psi[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        x = (forward[:, i - 1] @ trans) * psi[:, i]
        forward[:, i] = x / x.sum(1, keepdims=True)
    pairs = np.zeros((s, s))
    for i in range(t - 2, -1, -1):
        live = (i + 1 < length)[:, None]
        ahead = psi[:, i + 1] * back[:, i + 1]
        x = ahead @ trans.T
        back[:, i] = np.where(live, x / x.sum(1, keepdims=True), 1.0)
        norm = ((forward[:, i] @ trans) * ahead).sum(1, keepdims=True)
        pairs += (forward[:, i].T @ (ahead / norm * live)) * trans
    m = forward * back
    m /= m.sum(2, keepdims=True)
    m[np.arange(t)[None, :] >= length[:, None]] = 0
    return m, pairs


def fit() -> dict:
    """The weights, fitted on invented texts by adaptive gradient steps on the conditional likelihood.

    In a third of the texts the patterns' proposals are hidden, so that the field learns the forms themselves.
    """
    words = vocabulary()
    data = invented(FIT_TEXTS, vocabulary=sorted(w for w in words if 4 < len(w) < 9))
    r = random.Random(3)
    counts: dict[str, int] = {}
    for text, spans in data:
        for m in re.finditer(r"[^\W\d_]+", text):
            if not any(a <= m.start() < b for a, b, _ in spans):
                counts[m.group().lower()] = counts.get(m.group().lower(), 0) + 1
    carriers = " ".join([*_lines(_TO_NAME), *_lines(_WEAK), *(c for x in _TO_ITEM.values() for c in x.split("|")), *_lines(_PLAIN)])
    lexicon = frozenset(w.lower() for w in re.findall(r"[^\W\d_]+", re.sub(r"\{\w*\}", " ", carriers)) if counts.get(w.lower(), 0) > 9)
    forms: dict[str, int] = {}
    names: dict[str, int] = {}
    rows: list[list[int]] = []
    packed = []
    for text, spans in data:
        tokens, starts, ends = tokenised(text)
        ids = []
        for w in tokens:
            hidden = r.random() < 0.15  # the word itself is not seen
            form = ("?" + w) if hidden else w
            if form not in forms:
                forms[form] = len(rows)
                rows.append([names.setdefault(f, len(names)) for f in features(w, frozenset() if hidden else lexicon, words)])
            ids.append(forms[form])
        gold = np.zeros(len(tokens), np.int64)
        for a, b, kind in spans:
            first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
            gold[first:last] = 2 + 2 * KINDS.index(kind)
            gold[first] = 1 + 2 * KINDS.index(kind)
        flags = flag_columns(text, starts, ends)
        packed.append((np.array(ids), flags * (r.random() > 0.33), gold))
    matrix = np.zeros((len(rows) + 1, len(names)), np.float32)
    for i, row in enumerate(rows):
        matrix[i, row] = 1
    edge = len(rows)
    s = len(STATES)
    w = np.zeros((2 * REACH + 1, len(names), s))
    flag = np.zeros((len(FLAGS), s))
    move = np.zeros((s, s))
    bias = np.zeros(s)
    speed = [np.full_like(x, 1e-3) for x in (w, flag, move, bias)]
    order = np.random.default_rng(1)
    for _ in range(FIT_ROUNDS):
        for batch in np.array_split(order.permutation(len(packed)), 32):
            part = [packed[i] for i in batch]
            length = np.array([len(x[0]) for x in part])
            t = int(length.max())
            ids = np.full((len(part), t + 2 * REACH), edge)
            flags = np.zeros((len(part), t, len(FLAGS)), np.float32)
            gold = np.zeros((len(part), t), np.int64)
            for k, (a, f, g) in enumerate(part):
                ids[k, REACH : REACH + len(a)], flags[k, : len(a)], gold[k, : len(a)] = a, f, g
            tables = matrix @ w
            score = sum(tables[o][ids[:, o : o + t]] for o in range(2 * REACH + 1)) + flags @ flag + bias
            m, pairs = marginals(score, move, length)
            live = np.arange(t)[None, :] < length[:, None]
            delta = (np.eye(s)[gold] - m) * live[:, :, None]
            true_pairs = np.zeros((s, s))
            both = live[:, 1:]
            np.add.at(true_pairs, (gold[:, :-1][both], gold[:, 1:][both]), 1)
            flat = delta.reshape(-1, s)
            grads = [
                np.stack([matrix.T @ np.stack([np.bincount(ids[:, o : o + t].ravel(), flat[:, c], edge + 1) for c in range(s)], 1) for o in range(2 * REACH + 1)]) - 0.01 * w,
                np.einsum("ntf,nts->fs", flags, delta) - 0.01 * flag,
                true_pairs - pairs - 0.01 * move,
                flat.sum(0),
            ]
            for x, g, v in zip((w, flag, move, bias), grads, speed):
                v += g * g
                x += 0.35 * g / np.sqrt(v)
    return {"stamp": np.array(stamp()), "names": np.array(list(names)), "w": w.astype(np.float16), "flag": flag.astype(np.float16), "move": move.astype(np.float16), "bias": bias.astype(np.float16), "lexicon": np.array(sorted(lexicon))}


def stamp() -> str:
    """A digest of what the fit depends on."""
    return hashlib.sha256("\n".join([_TO_NAME, _WEAK, *_TO_ITEM.values(), _PLAIN, str((FIT_TEXTS, FIT_ROUNDS, REACH))]).encode()).hexdigest()


@lru_cache(maxsize=1)
def trained() -> dict:
    """The stored weights; it is an error if they were fitted to other texts than the present ones."""
    with np.load(WEIGHTS, allow_pickle=False) as stored:
        if str(stored["stamp"]) != stamp():
            raise ValueError("the invented texts have changed; run python -m tarn.llm.pii")
        out = {k: stored[k].astype(np.float32) for k in ("w", "flag", "move", "bias")}
        return out | {"names": {n: i for i, n in enumerate(stored["names"].tolist())}, "lexicon": frozenset(stored["lexicon"].tolist())}


class Field:
    """The fitted field with the scores of the token forms met so far."""

    def __init__(self, model: dict, words: frozenset):
        self.model, self.words = model, words
        self.reset()

    def reset(self) -> None:
        self.forms: dict[str, int] = {}
        self.tables = [np.zeros((2 * REACH + 1, len(STATES)), np.float32)]
        self.new: list[bool] = [False]
        self.stacked = None

    def number(self, token: str) -> int:
        at = self.forms.get(token)
        if at is None:
            found = features(token, self.model["lexicon"], self.words)
            ids = [self.model["names"][f] for f in found if f in self.model["names"]]
            at = self.forms[token] = len(self.tables)
            self.tables.append(self.model["w"][:, ids].sum(1))
            self.new.append(found[-1].startswith("new:"))
            self.stacked = None
        return at

    def unaries(self, ids: list[np.ndarray], flags: list[np.ndarray]) -> list[np.ndarray]:
        """Scores of several texts' tokens, the texts laid end to end with a gap of REACH empty tokens between them."""
        if self.stacked is None:
            self.stacked = np.stack(self.tables)
        gap = np.zeros(REACH, np.int64)
        row = np.concatenate([x for own in ids for x in (gap, own)] + [gap])
        n = len(row) - 2 * REACH
        score = np.tile(self.model["bias"], (n, 1))
        for o in range(2 * REACH + 1):
            score += self.stacked[row[o : o + n], o]
        out, at = [], 0
        for own, flag in zip(ids, flags):
            part = score[at : at + len(own)]
            busy = flag.any(1)
            if busy.any():
                part[busy] += flag[busy] @ self.model["flag"]
            out.append(part)
            at += len(own) + REACH
        return out

    def decode(self, scores: list[np.ndarray]) -> list[np.ndarray]:
        """Best states of several texts: one Viterbi over all of them, the longest first."""
        order = sorted(range(len(scores)), key=lambda k: -len(scores[k]))
        length = np.array([len(scores[k]) for k in order])
        flat = np.concatenate([scores[k] for k in order]) if order else np.empty((0, len(STATES)))
        first = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64)
        back = np.zeros((len(flat), len(STATES)), np.int8)
        best = flat[first].copy()
        last = best.copy()
        move = self.model["move"]
        for step in range(1, int(length[0])):
            live = int(np.searchsorted(-length, -step, "left"))
            rows = first[:live] + step
            through = best[:live, :, None] + move
            back[rows] = through.argmax(1)
            best = through.max(1) + flat[rows]
            last[:live] = best
        state = np.zeros(len(flat), np.int64)
        state[first + length - 1] = last.argmax(1)
        for step in range(int(length[0]) - 1, 0, -1):
            live = int(np.searchsorted(-length, -step, "left"))
            rows = first[:live] + step
            state[rows - 1] = back[rows, state[rows]]
        out: list = [None] * len(scores)
        for k, a, n in zip(order, first, length):
            out[k] = state[a : a + n]
        return out

    def edges(self, tokens: list[str], new: list[bool]) -> list[list[int]]:
        """The skip edges of a text: groups of alike words that the vocabulary does not know."""
        groups: dict[str, list[int]] = {}
        for i, (w, fresh) in enumerate(zip(tokens, new)):
            if fresh and len(w) >= ALIKE:
                groups.setdefault(w.lower()[: max(ALIKE, len(w) - 2)], []).append(i)
        return [g for g in groups.values() if len(g) > 1]

    def pass_messages(self, scores: list[np.ndarray], edges: list[list[list[int]]]) -> list[np.ndarray]:
        """Scores of texts of similar length with the messages along their skip edges: alike words pull each other to one kind."""
        length = np.array([len(x) for x in scores])
        base = np.zeros((len(scores), int(length.max()), len(STATES)))
        for k, x in enumerate(scores):
            base[k, : len(x)] = x
        text = np.concatenate([np.full(len(g), k) for k, groups in enumerate(edges) for g in groups])
        place = np.concatenate([np.array(g) for groups in edges for g in groups])
        sizes = np.array([len(g) for groups in edges for g in groups])
        group = np.repeat(np.arange(len(sizes)), sizes)
        out = base
        for _ in range(ROUNDS):
            m, _ = marginals(out, self.model["move"].astype(np.float64), length)
            own = m[text, place]
            total = np.zeros((len(sizes), len(STATES)))
            np.add.at(total, group, own)
            message = SKIP_WEIGHT * (total[group] - own) / (sizes[group] - 1)[:, None]
            message[:, 0] = 0
            out = base.copy()
            out[text, place] += message
        return [out[k, : len(x)] for k, x in enumerate(scores)]

    def find(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """(start, end, kind) of the personal items of each text, in order."""
        if len(self.forms) > REMEMBERED:
            self.reset()
        scores, ready = [], []
        for k, text in enumerate(texts):
            tokens, starts, ends = tokenised(text) if text else ([], [], [])
            if tokens:
                ids = np.array([self.number(w) for w in tokens], np.int64)
                ready.append((k, text, tokens, starts, ends, ids))
        if ready:
            scores = self.unaries([x[5] for x in ready], [flag_columns(text, starts, ends) for _, text, _, starts, ends, _ in ready])
        parts = [x[:5] for x in ready]
        states = self.decode(scores) if scores else []
        if SKIP_WEIGHT:
            again = []
            for at, (_, _, tokens, _, _, ids) in enumerate(ready):
                if states[at].any():
                    groups = [g for g in self.edges(tokens, [self.new[i] for i in ids]) if states[at][g].any()]
                    if groups:
                        again.append((len(tokens), at, groups))
            again.sort(key=lambda x: x[0])
            begin = 0
            while begin < len(again):
                stop = begin + 1
                while stop < len(again) and again[stop][0] * (stop + 1 - begin) <= BATCH_TOKENS:
                    stop += 1
                block = again[begin:stop]
                for (_, at, _), score in zip(block, self.pass_messages([scores[at] for _, at, _ in block], [g for _, _, g in block])):
                    scores[at] = score
                begin = stop
            if again:
                for (_, at, _), found in zip(again, self.decode([scores[at] for _, at, _ in again])):
                    states[at] = found
        out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        for (k, text, tokens, starts, ends), found in zip(parts, states):
            out[k] = settled(text, tokens, starts, ends, found)
        return out


def plausible(text: str, kind: str) -> bool:
    """The least form of an item that no pattern proposed."""
    digits = sum(c.isdigit() for c in text)
    if kind == "phone":
        return 8 <= digits <= 13 and not re.search(r",|\d[.]\d.*/", text) and not re.search(r"[^\W\d_]{2}", text)
    if kind == "id_number":
        return digits >= 6 and len(text) >= 8 and not re.search(r"[,.₹%:]|^[^\W\d_]+ ", text)
    if kind == "email":
        return "@" in text and len(text) >= 6 and " " not in text.strip()
    return digits > 0 and len(text.split()) >= 4


def settled(text: str, words: list[str], starts: list[int], ends: list[int], states: np.ndarray) -> list[tuple[int, int, str]]:
    """Spans of the states: proposals the field accepts are taken whole; names are cut to their name tokens."""
    spans = []
    i = 0
    busy = np.flatnonzero(states)
    if not len(busy):
        return []
    offered = proposals(text)
    while i < len(states):
        if not states[i]:
            i += 1
            continue
        kind = KINDS[(states[i] - 1) // 2]
        j = i + 1
        while j < len(states) and states[j] == 2 + 2 * KINDS.index(kind):
            j += 1
        a, b = starts[i], ends[j - 1]
        if kind == "person":
            x, y = i, j
            while x < y and (not words[x].isalpha() or words[x].lower() in TITLES):
                x += 1
            y = next((k for k in range(x + 1, y) if "\n" in text[ends[k - 1] : starts[k]] or not (words[k].isalpha() or words[k] in ".-'’")), y)
            while y > x and not (words[y - 1].isalpha()):
                y -= 1
            closed = any(w.lower() in CLOSING for w in words[max(x, y - 1) : y + 2])
            if sum(w.isalpha() and len(w) > 1 for w in words[x:y]) >= 2 and not closed and not any(w.lower() in NO_NAMES and (len(w) > 1 or w == "a") for w in words[x:y]):
                spans.append((starts[x], ends[y - 1], kind))
        else:
            near = [(min(b, q) - max(a, p), q - p, p, q) for p, q, name in offered if KIND_OF[name] == kind and p < b and q > a]
            if near:
                _, _, p, q = max(near)
                spans.append((p, q, kind))
            else:
                while b > a and not text[b - 1].isalnum():
                    b -= 1
                if plausible(text[a:b], kind):
                    spans.append((a, b, kind))
        i = j
    out: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(set(spans)):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


# ---- tables --------------------------------------------------------------------------------------------------------


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType())]))


def with_spans(df: DataFrame, text: str, *, out: str = "pii", words: str = VOCABULARY) -> DataFrame:
    """df with `out`, the personal items of the text column: (kind, char_start, char_end) in code points, in order.

    Null and blank texts have an empty list. Whole texts are read. Rows, repeated or not, stay as they are; a column
    that is already called `out` is an error. words is the path of the public vocabulary file.
    """
    if out in df.columns:
        raise ValueError(f"the input already has a column {out}")
    ship_package(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((trained(), vocabulary(words)))

    def run(batches, shared=shared, text=text, out=out):
        from tarn.llm.pii import BATCH_TOKENS, Field

        field = Field(*shared.value)
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("char_start", pa.int32()), ("char_end", pa.int32())]))
        for batch in batches:
            size = pa.compute.fill_null(pa.compute.utf8_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
            block = np.cumsum(size) // (4 * BATCH_TOKENS)
            cuts = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(size) else np.zeros(1, np.int64)
            for at, stop in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                part = batch.slice(at, stop - at)
                found = field.find(part.column(part.schema.get_field_index(text)).to_pylist())
                spans = [[{"kind": k, "char_start": a, "char_end": b} for a, b, k in x] for x in found]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(spans, kinds)], names=[*part.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, SPANS)]))


def masked(df: DataFrame, text: str, *, out: str = "masked", words: str = VOCABULARY) -> DataFrame:
    """df with `out`: the text with every personal item replaced by [KIND]; all else is unchanged. Null stays null."""
    found = with_spans(df, text, out="_pii", words=words)
    parts = F.transform("_pii", lambda s, i: F.concat(F.substring(F.col(text), F.when(i == 0, 0).otherwise(F.try_element_at(F.col("_pii"), i)["char_end"]) + 1, s["char_start"] - F.when(i == 0, 0).otherwise(F.try_element_at(F.col("_pii"), i)["char_end"])), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    tail = F.substring(F.col(text), F.coalesce(F.try_element_at("_pii", F.lit(-1))["char_end"], F.lit(0)) + 1, F.length(text))
    return found.withColumn(out, F.concat(F.array_join(parts, ""), tail)).drop("_pii")


def records(golden_set: DataFrame, corpus_docs: DataFrame) -> DataFrame:
    """(src, rec_id, node_order, text), distinct, of the questions and the node texts."""
    questions = golden_set.select(F.lit("golden_set").alias("src"), F.col("qid").alias("rec_id"), F.lit(0).alias("node_order"), F.col("question").alias("text"))
    nodes = corpus_docs.select("page_id", F.explode("nodes").alias("n")).select(F.lit("corpus_docs").alias("src"), F.col("page_id").cast("string").alias("rec_id"), F.col("n.node_order").cast("int").alias("node_order"), F.col("n.text").alias("text"))
    return questions.unionByName(nodes).where("rec_id is not null and text is not null and trim(text) <> ''").distinct()


def found(golden_set: DataFrame, corpus_docs: DataFrame, *, words: str = VOCABULARY) -> DataFrame:
    """(src, rec_id, node_order, kind, char_start, char_end) of each personal item."""
    spans = with_spans(records(golden_set, corpus_docs), "text", words=words)
    return spans.select("src", "rec_id", "node_order", F.explode("pii").alias("p")).select("src", "rec_id", "node_order", "p.kind", "p.char_start", "p.char_end").distinct()


if __name__ == "__main__":
    np.savez_compressed(WEIGHTS, **fit())
