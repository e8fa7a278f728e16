"""Labelled snippets with invented personal data and look-alikes, for training the span classifier.

A snippet is one or two frames with values in their slots, and filler around them. Frames belong to one of three sets by
their place in the list: most train the trees, every fifth calibrates thresholds, every fifth tests. A frame is never in
two sets, so what is measured is other wording and not the generator. None of the frames stands in the test tables.

Names are common ones of many languages and ones put together from syllables; a part of both is withheld from the list of
known names, as in a real corpus. Numbers with check digits come with right ones in half of the cases; others are drawn.
"""

from __future__ import annotations

import random
import re

SETS = ("train", "calibrate", "test")

# Common given and family names of many languages.
GIVEN = "Aisha Alejandro Amara Ana Anders Andrzej Anh Anna Antonio Arjun Astrid Ayşe Beatriz Björn Camille Carlos Carmen Chiara Chinedu Claire David Deepa Diego Dmitri Elena Elif Emeka Emma Fatima Fernando Giulia Gustavo Hannah Hans Hassan Helena Ibrahim Ingrid Isabel Ivan Jack James Jan Jean Joana John Jose Julia Julien Jürgen Karim Katarzyna Kemal Kofi Kwame Lars Laura Leila Li Lucia Luis Luc Magda Manuel Marco Maria Marie Marta Mehmet Mei Michael Mikhail Mohammed Nadia Ngozi Nikolai Nina Olga Olivier Omar Paolo Paulo Pedro Peter Petra Pierre Piotr Priya Rafael Rajesh Ravi Rosa Samuel Sanjay Sara Sebastian Sergei Sofia Stefan Sunita Susan Svetlana Thomas Tomasz Ursula Valentina Vikram Wei William Yasmin Yusuf Zoe".split()
FAMILY = "Adeyemi Ahmed Andersson Becker Bernard Bianchi Brown Carvalho Castillo Chatterjee Chen Costa Delgado Demir Diaz Dubois Eriksson Esposito Fernandes Ferrari Fischer Fontaine Garcia Girard Gonzalez Gupta Hansen Hernandez Hoffmann Hussain Ivanov Iyer Jensen Jiménez Johansson Johnson Kaya Keller Khan Kim Kowalczyk Kowalski Krishnan Kumar Lambert Larsen Laurent Lefebvre Lindberg Lopez Marino Martin Martinez Mbeki Mehta Mendes Meyer Moreau Moreno Müller Murphy Nair Navarro Nguyen Nielsen Novak Nowak Okafor Okonkwo Oliveira Olsen Ortega Patel Pereira Petrov Popescu Raman Reddy Ribeiro Ricci Richter Rodriguez Romano Rossi Rousseau Sanchez Santos Schmidt Schneider Sharma Silva Singh Smith Sokolov Suzuki Svensson Taylor Tran Vargas Vasquez Wagner Walker Wang Weber Williams Wojcik Wright Yilmaz Zhang Zielinski".split()
KANJI_FAMILY = "山田 佐藤 鈴木 高橋 田中 伊藤 渡辺 中村 小林 加藤 吉田 山本 松本 井上 木村".split()
KANJI_GIVEN = "太郎 花子 健一 美咲 翔太 陽子 直樹 恵子 大輔 由美".split()
# Names that are ordinary words too.
PLAIN_NAMES = "Faith Heath Ivy Mark Iris Holly Frank Chase Violet Summer Basil Ruby Jasper Hope Sky".split()

# Syllables and words of the invented texts.
_HEADS = "bra cor dal eli fen gar hol ira jun kel lor mar nor ola per qui ras sel tor ulm val wes yor zan".split()
_MIDDLES = "a e i o u an el in or ul".split()
_GIVEN_ENDS = "da lin mo ra ris sa ta va wyn xa".split()
_FAMILY_ENDS = "berg by dale feld gaard holm land mark quist son stad thorpe wood worth".split()
_KANA = "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"
_FILL = {
    "n": "invoice contract printer heater parcel meeting lecture garden engine ledger schedule brochure device cluster server folder module table window".split(),
    "v": "repair review send approve cancel replace print refund update deliver inspect move".split(),
    "a": "late quiet broken annual heavy empty second spare weekly open blue short".split(),
    "k": "会議 請求書 契約 荷物 資料 予約 見積 報告 点検 修理".split(),
    "c": "Lisbon Graz Osaka Leeds Porto Malmo Turin Ghent Brno Cork".split(),
    "o": "Northwind Acme Contoso Globex Initech Umbra Vertex Solaris".split(),
}
_STREET_WORDS = "Street St. Avenue Ave. Road Rd Lane Court Blvd Drive Terrace Way Close".split()
_ROMANCE = "rue|avenue|boulevard|place|chemin|allée|quai".split("|")
_GERMAN = "weg straße gasse platz allee str.".split()
_TLDS = "example.com example.org example.net test invalid example".split()
_REGIONS = "青森県 長野県 大阪府 東京都".split()
_TOWNS = "星川市 月野市 風見市 港区".split()
_BLOCKS = "若葉台 東雲 花園 中央".split()

FRAMES = r"""
You can reach the landlord at {EMAIL} any time.
Please forward the {n} to {EMAIL} by Friday.
Mail {EMAIL} for the keys.
E-Mail an {EMAIL} genügt.
Contact: {EMAIL}
cc {EMAIL}
<{EMAIL}>
sender={EMAIL};
"email": "{EMAIL}",
{EMAIL}
メールは {EMAIL} へお願いします。
お問い合わせ: {EMAIL}
Escribe a {EMAIL} si no llega.
Answer came from mailto:{EMAIL}.
unique key violated for ({EMAIL}) again
author_email = '{EMAIL}'
signed up as {EMAIL} yesterday
{EMAIL}; {EMAIL}; {EMAIL}
Notify {EMAIL} and {EMAIL}.
The bounce for {EMAIL} is back
Phone {PHONE} before noon.
Ring me on {PHONE}, please.
tel {PHONE}
Tel.: {PHONE}
Mobil: {PHONE}
cell phone {PHONE} (evenings)
fax {PHONE}
"phone": "{PHONE}"
Der Hausmeister ist unter {PHONE} erreichbar.
Bitte um Anruf: {PHONE}.
お電話は {PHONE} にどうぞ。
電話番号 {PHONE}
携帯: {PHONE}
Tu número es {PHONE}, ¿verdad?
Mein Handy {PHONE}
mon numéro : {PHONE}
número {PHONE}
Handynummer: {PHONE}
numéro {PHONE}
Appelez le {PHONE} ce soir.
{PHONE}
dial {PHONE} and ask for the {n}
the on-call number is {PHONE} until Sunday
SMS to {PHONE} worked
hotline {PHONE} is busy
Her {IDL} is on file.
{IDL}
We copied {IDL} by mistake.
Kopie: {IDL} liegt bei.
Please check {IDL}, it seems wrong.
記入: {IDL}
my {IDL} for the visa
applicant ({IDL}) was rejected
{IDL} / {PHONE}
Customer gave {IDL}.
The scan shows {IDL}.
his {IDL} expired
確認書類 {IDL}
paid with {IDL} on Monday
Transfer it to {IBAN} today.
Bitte auf {IBAN} überweisen.
payable to {IBAN}
no,person,mail,ssn
7,{NAME},{EMAIL},{SSN}
"taxId": "{SSN}"
{d3};{NAME};{SSN};{c}
{EMAIL},{SSN}
{SSN}
{n}|{SSN}|{d2}
{d2},{n},{SSN}
no.\t{SSN}\t{n}
export: {d1},{EMAIL},{SSN},{a}
Deliver the {n} to {ADDR}.
Our new address is {ADDR}
Adresse: {ADDR}
Lieferung nach {ADDR}.
Die Firma sitzt jetzt in {ADDR}.
address = {ADDR}
billing address {ADDR}
住所 {ADDR}
お届け先: {ADDR}
送付先は {ADDR} です。
She lives at {ADDR}, second floor.
"address": "{ADDR}"
{ADDR}
Send returns to {ADDR}.
Dirección: {ADDR}
Send the spare key of the {n} to {ADDR}.
Wohnhaft: {ADDR}
visit us at {ADDR}
{NAME} wants to {v} the {n}.
{NAME} wrote the {n} and {v}s it.
{NAME} approved the {a} {n}.
{NAME} said the {n} is {a}.
{NAME} will {v} it tomorrow.
{NAME} told us to {v} the {n}.
{NAME} called about the {n}
I spoke with {NAME} about the {n}.
Ask {NAME} for the {a} {n}.
assigned to {NAME}
owner: {NAME}
name: {NAME}
Author: {NAME}
"name": "{NAME}", "phone": "{PHONE}"
"fullName": "{NAME}", "address": "{ADDR}"
{NAME}
{NAME}
{NAME}
{NAME}, {ADDR}
From: {NAME} <{EMAIL}>
Dear {NAME},
Thanks, {NAME}
Kind regards,\n{NAME}
Cheers,\n{NAME}
Mit freundlichen Grüßen\n{NAME}
Yours,\n{NAME}\n{c}
Sincerely,\n{NAME}\n{PHONE}
Bis bald\n{NAME}
{NAME}\nHead of {n}s\n{PHONE}
{NAME}\n{o}, {c}\n{PHONE}\n{EMAIL}
{NAME}\n{PHONE}
{NAME}\n{c} desk\n{PHONE}
{o} {n}s, {c}\n{PHONE}\n{EMAIL}
{PHONE}\n{EMAIL}
{NAME}\n{EMAIL}\n{PHONE}
approved-by: {LOWER}
tested-by: {LOWER}
signed-off-by: {LOWER}
contact = {LOWER}
acked-by: {LOWER}
Mr. {FAMILY} complained about the {n}.
Mrs {FAMILY} will {v} it.
Dr. {FAMILY} confirmed the {n}.
Prof. {FAMILY} read the {n}
Herr {FAMILY} hat den Vertrag geprüft.
Frau {FAMILY} bestätigt die Lieferung.
Frau {FAMILY} hat die Rechnung bezahlt.
El Sr. {FAMILY} llamó dos veces.
La Sra. {FAMILY} no contesta.
Mme {FAMILY} est absente.
Monsieur {FAMILY} a signé.
Speak to {GIVEN} about the {n}.
I met {GIVEN} at the {n}.
Go to {GIVEN} for the {n}.
Give it to {GIVEN} on Monday.
Thanks to {GIVEN} the {n} works.
{GIVEN} and {GIVEN} share the {n}
Frag {GIVEN} nach dem Vertrag.
mit {FAMILY} besprochen
a note from {GIVEN}, who left
ask {FAMILY} first
お名前 {KNAME}
氏名: {KNAME} / 電話番号 {PHONE}
担当者 {KNAME} / 住所 {ADDR}
{KFAM}さんに聞いてください。
{KFAM}様からの{k}です。
{KFAM}さんが{k}を確認した。
{KFAM}氏に{k}を渡した。
{KNAME}様のご{k}です。
{KNAME}さんへ
{KFAM}先生の{k}
The {p} {n} is {a}.
{p} mode, {d3} px
the {p} and {p} lines share a {n}
{p} {n} {d1}.{d1} was released
A {p} {n} costs less.
{p} theme
version {d1}.{d2}.{d3}.{d4}
call {d2}.{d3} gave up, {d4} ms
ticket {d8} was closed on {d4}-0{d1}-1{d1}
order no. {d6} of {d8}
{d4}-{d2}-{d2} {d2}:{d2}:{d2}.{d3} WARN {n}: slow, {d3} ms
[{d2}:{d2}:{d2}.{d3}] INFO {v}_{n} count={d3}
192.168.{d2}.{d2} - - "PUT /{n}/{d3}" 201 {d5}
rows {d3} to {d9} from 172.16.{d2}.{d3}
parcel {d10} arrived
job {d10} needs {d4} MB
offset {d4}-{d4}-{d4} in the {n}
chunk {d3}-{d4}-{d3} of the {n}
range {d3}-{d3}-{d4}
build {d4}.{d2}.{d2}.{d4}
{n} {d3} {d3} {d3} {d3} {d2} {d3}
{d3} {d3} {d2} {d3}.{d3} {d3} {d2}
{n}   {d3}   {d3}   {d4}
uuid {h8}-{h4}-{h4}-{h4}-{h12}
checksum {h40}
commit {h8}
sha256:{h40}{h12}{h12}
id={d9}
serial {d4}-{d4}
part AB{d5}C in stock
error E{d5}
price {d3}.{d2} and {d2} {d3} {d3} pieces
ean {d13}
port {d5}, pid {d5}
page {d2} of {d3}
git clone git@code.{n}.invalid:{n}/{v}.git
git clone git@172.16.{d1}.{d2}:{n}/{v}.git
ssh root@gate.{n}.test
ssh {n}@box.inner.invalid
ssh -p {d4} {n}@gate.{n}.invalid
sftp {n}@drop.{n}.test
ssh {v}@db.{n}.example
connect with ssh {n}@hub.{n}.example -v
ssh {n}@sql.{v}.invalid uptime
git remote add up ssh://git@forge.{n}.invalid/{n}.git
scp {n}@files.{n}.invalid:/srv/{n} .
postgres://{n}:pw{d4}@sql.{n}.invalid/{v}
npm add {n}@{d1}.{d2}.{d1}
requires {n}@{d1}.{d2}
@{n}.route(path={d3})
docker run zan{n}/{n}@sha256:{h40}
user@localhost
rsync backup@store.inner.invalid:/data .
Due to Fair Use limits
Reading List
Start Page
Street Map
Road Works ahead, {d1} lanes
Way {d1} of {d2}
{d2} Main Points, Summary
Box {d2} of {d3}
Court Order {d3}
Upper Case
New Window
ALL DONE
NOT READY
READ ONLY mode
Erste Fassung
Alte Rechnung prüfen
Nächste Woche Montag
Zum Beispiel Freitag
Good Evening
In Review
Last Monday, Tuesday
Error Report
Meeting Notes
{T} {T} is {a}
see {T} {T} first
wait for {T} {T}
order {d4} waits for {T} {T}
issue AB-{d2}-{d4} needs {T} {T}
the plan is in {T} {T}, page {d2}
{T} {T}
{T} {T} {d1}
Ohne Termin geht hier nichts.
Ohne Vertrag wird nicht geliefert.
Nach Feierabend wird geputzt.
Beide Seiten haben zugestimmt.
Neue Heizung steht bereit, {d3} Stunden lang.
Kleine Pakete kommen zuerst.
Vor Weihnachten wird {d2} Mal gezählt.
Unter Umständen lässt es sich lösen.
Jede Woche kommt eine Rechnung.
- Ohne Rechnung hilft uns das wenig
Open Questions, Next Steps
Made in {c}
{c} office
{o} Ltd ships the {n}
The {o} {n} is down
from {c} to {c}
SELECT COUNT of {n}
GET /{n} from 172.16.{d3}.{d3}
name: {n} {v}
owner: {a} {n}
from: {n} {n}
approved-by: nobody yet
status: still waiting
contact: see below
エラー・メッセージ
サーバー構成
テーブル・ロックの{k}
データ ベース
お客様の{k}
皆様へ
お疲れ様です。
奥さんの{k}
客先の{k}様式
see ISO 9001 and RFC 3339
-----BEGIN CERTIFICATE REQUEST-----
-----END PUBLIC KEY BLOCK-----
-----BEGIN DSA PARAMETERS-----
class {p}Handler
""".strip().split("\n")

FILLERS = """
The {n} has been {a} since the last {n}.
Could you {v} the {n} for me
It took {d2} minutes to {v} it.
Nobody wants to {v} the {a} {n}.
go ahead
Use `{v}_{n}` here, not `{n}_{v}`.
{d2} tests ok, {d1} broken
pip install {n}=={d1}.{d2}.{d1}
at {v}_{n} ({n}/{v}.js:{d3})
{k}はまだ届いていない。
{k}を{d2}回確認した。
次の{k}までに{n}を直す。
Die Rechnung ist noch offen.
""".strip().split("\n")

_SLOT = re.compile(r"\{(\w+)\}")


def verhoeff_digit(digits: str) -> str:
    """The check digit by the dihedral group of order ten, built by rule."""
    rows = [[(i + j) % 5 + 5 * ((i < 5) != (j < 5)) if i < 5 else (i - j) % 5 + 5 * (j < 5) for j in range(10)] for i in range(10)]
    turn = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]
    c = 0
    for n, d in enumerate(reversed(digits), 1):
        x = int(d)
        for _ in range(n % 8):
            x = turn[x]
        c = rows[c][x]
    return str(next(i for i in range(10) if rows[c][i] == 0))


class _Writer:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        word = lambda ends: (r.choice(_HEADS) + (r.choice(_MIDDLES) if r.random() < 0.4 else "") + r.choice(ends)).capitalize()
        made_given, made_family = sorted({word(_GIVEN_ENDS) for _ in range(110)}), sorted({word(_FAMILY_ENDS) for _ in range(150)})
        kana = lambda: "".join(r.choice(_KANA) for _ in range(r.choice((3, 3, 4))))
        self.kana_given, self.kana_family = (sorted({kana() for _ in range(16)}) for _ in range(2))
        # Half of the common names can't be known from the list in `GIVEN` and `FAMILY` either: they are spelt anew.
        self.given = made_given + GIVEN + PLAIN_NAMES
        self.family = made_family + FAMILY
        self.places = sorted({word(["burgh", "ford", "haven", "mouth", "ton", "wick"]) for _ in range(40)}) + _FILL["c"]
        self.street = sorted({word(["brook", "hill", "moor", "ley", "gate"]) for _ in range(30)})
        self.domains = sorted({word(["net", "mail", "soft", "lab"]).lower() for _ in range(20)})
        self.known = (
            [(x, "given") for x in made_given if r.random() < 0.75]
            + [(x, "given") for x in PLAIN_NAMES]
            + [(x, "family") for x in made_family if r.random() < 0.8]
            + [(x, "given") for x in self.kana_given if r.random() < 0.6]
            + [(x, "family") for x in self.kana_family if r.random() < 0.8]
        )

    def d(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def up(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def wide(self, s: str) -> str:
        return s.translate({48 + i: 0xFF10 + i for i in range(10)} | {45: 0xFF0D})

    def email(self) -> str:
        r = self.r
        g, f = r.choice(self.given).lower(), r.choice(self.family).lower()
        local = r.choice([f"{g}.{f}", f"{g}-{f}", f"{g}_{self.d(2)}", g[0] + f, f"{f}+{r.choice(_FILL['n'])}", "x" + self.d(3) + "af" + self.d(3), f"{g}{self.d(2)}", f, "info", f"{g}.{f}{self.d(1)}"])
        domain = r.choice(["", "", "mail.", "eu."]) + r.choice(self.domains) + "." + r.choice(_TLDS)
        at, dot = r.choice([("@", ".")] * 6 + [("＠", "."), (" (at) ", "."), (" [at] ", " [dot] ")])
        out = local + at + domain.replace(".", dot)
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        r, d = self.r, self.d
        country = r.choice(["1", "7", "20", "27", "31", "33", "34", "39", "44", "48", "49", "55", "61", "81", "90", "91", "353", "971"])
        return r.choice(
            [
                f"+{country} {d(2)} {d(4)} {d(4)}", f"+{country} {d(3)} {d(6)}", f"+{country} {d(2)} {d(8)}", f"+{country} ({d(3)}) {d(3)}-{d(4)}", f"+{country}{d(9)}", f"+{country} {d(2)} {d(3)} {d(2)} {d(2)}", f"+{country}-{d(3)}-{d(3)}-{d(4)}",
                f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)} ext. {d(3)}", f"1-{d(3)}-{d(3)}-{d(4)} x{d(2)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)}-{d(4)}-{d(4)}",
                f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", self.wide(f"0{d(2)}-{d(4)}-{d(4)}"), f"0{d(2)}-{d(4)}-{d(4)}", f"00{country} {d(3)} {d(5)}", f"0{d(3)} {d(6)}", f"0{d(3)}/{d(6)}".replace("/", " "),
            ]
        )

    def luhn(self, n: int) -> str:
        body = self.d(n - 1)
        total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def iban(self) -> str:
        r = self.r
        country, bank, n = r.choice([("DE", "", 18), ("GB", self.up(4), 14), ("NL", self.up(4), 10), ("ES", "", 20), ("FR", "", 23), ("ZZ", self.up(4), 12), ("IT", self.up(1), 22)])
        body = bank + self.d(n)
        check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97 if r.random() < 0.6 else r.randint(0, 97)
        whole = f"{country}{check:02d}{body}"
        return whole if r.random() < 0.4 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4))

    def ssn(self) -> str:
        return f"{self.r.choice(['666', '000', self.d(3)])}-{self.d(2)}-{self.d(4)}"

    def idnumber(self) -> tuple[str, str]:
        """Label and number."""
        d, up, r = self.d, self.up, self.r
        card = self.luhn(16) if r.random() < 0.5 else d(16)
        nhs = d(9)
        nhs += str(-sum(int(c) * (10 - i) for i, c in enumerate(nhs)) % 11 % 10)
        aadhaar = r.choice("23456789") + d(10)
        aadhaar += verhoeff_digit(aadhaar)
        four = lambda s, sep: sep.join(s[i : i + 4] for i in range(0, len(s), 4))
        return r.choice(
            [
                ("IBAN", self.iban()), ("IBAN", self.iban()), ("bank account", self.iban()), ("SSN", self.ssn()), ("social security number", self.ssn()), ("social security number is", d(9)), ("social security no.", d(9)), ("ITIN", f"9{d(2)}-{d(2)}-{d(4)}"),
                ("passport no.", f"{up(1)}{d(8)}"), ("passport", f"{up(2)}{d(7)}"), ("passport number", f"{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}"), ("Reisepass", f"{up(1)}{d(2)}{up(1)}{d(2)}{up(1)}{d(2)}"), ("pasaporte", f"{up(3)}{d(6)}"), ("driving licence", f"{up(5)}{d(6)}{up(2)}{d(1)}"), ("driving licence", f"{up(5)}{d(6)}{up(2)}{d(1)}"), ("driver's license", f"{up(1)}{d(7)}"),
                ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("Steuernummer", d(11)), ("マイナンバー", four(d(12), " ")), ("マイナンバー", d(12)), ("card", four(card, " ")), ("credit card", four(card, "-")), ("card number", card), ("card", four(card, " ")),
                ("NINO", f"{up(2)} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}"), ("national insurance", f"{up(2)}{d(6)}{r.choice('ABCD')}"), ("tax id", f"{d(2)}-{d(7)}"), ("account", d(10)), ("旅券番号", f"{up(2)}{d(7)}"), ("免許証番号", d(12)), ("口座番号", d(8)),
                ("CPF", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}"), ("NHS number", f"{nhs[:3]} {nhs[3:6]} {nhs[6:]}"), ("Aadhaar", four(aadhaar, " ")), ("DNI", f"{d(8)}{up(1)}"), ("PESEL", d(11)), ("NIF", d(9)), ("personnummer", f"{d(6)}-{d(4)}"),
            ]
        )

    def address(self) -> str:
        r, d = self.r, self.d
        n, s, p = r.randint(1, 199), r.choice(self.street), r.choice(self.places)
        return r.choice(
            [
                f"{n} {s} {r.choice(_STREET_WORDS)}, {p}", f"{n} {s} {r.choice(_STREET_WORDS)}, {p} {d(5)}", f"{r.choice(['Flat', 'Apt', 'Unit'])} {n % 40 + 1}{r.choice('ABC')}, {n} {s} {r.choice(_STREET_WORDS)}, {p}", f"{n} {r.choice(_ROMANCE)} {s}", f"{n} {r.choice(_ROMANCE)} de {s}, {d(5)} {p}",
                f"{s}{r.choice(_GERMAN)} {n}, {d(5)} {p}", f"{s}{r.choice(_GERMAN)} {n}, {d(5)} {p}", f"{s}{r.choice(_GERMAN)} {n}", f"{r.choice(['P.O. Box', 'PO Box', 'Postfach', 'P.O. Box'])} {d(4)}, {p}", f"P.O. Box {d(3)}",
                f"〒{d(3)}-{d(4)} {r.choice(_REGIONS)}{r.choice(_TOWNS)}{r.choice(_BLOCKS)}{r.randint(1, 9)}-{r.randint(1, 30)}-{r.randint(1, 20)}", f"{r.choice(_REGIONS)}{r.choice(_TOWNS)}{r.choice(_BLOCKS)}{r.randint(1, 9)}-{r.randint(1, 30)}-{r.randint(1, 20)}",
            ]
        )

    def name(self) -> str:
        r = self.r
        g, f = r.choice(self.given), r.choice(self.family)
        return r.choice([f"{g} {f}"] * 5 + [f"{f}, {g}", f"{g} {self.up(1)}. {f}", f"{self.up(1)}. {f}", f"{g} {f}".upper(), f"{g}-{r.choice(GIVEN)} {f}"])

    def value(self, slot: str) -> list[tuple[str, str | None]]:
        r = self.r
        if slot in _FILL:
            return [(r.choice(_FILL[slot]), None)]
        if slot == "T":
            return [(r.choice(_FILL["n"] + _FILL["a"]).capitalize(), None)]
        if slot == "p":
            return [(r.choice(PLAIN_NAMES), None)]
        if slot[0] == "d":
            return [(self.d(int(slot[1:])), None)]
        if slot[0] == "h":
            return [("".join(r.choice("0123456789abcdef") for _ in range(int(slot[1:]))), None)]
        if slot == "IDL":
            label, number = self.idnumber()
            return [(label + r.choice([" ", " ", ": "]), None), (number, "idnumber")]
        made = {
            "EMAIL": (self.email, "email"), "PHONE": (self.phone, "phone"), "IBAN": (self.iban, "idnumber"), "SSN": (self.ssn, "idnumber"), "ADDR": (self.address, "address"), "NAME": (self.name, "name"),
            "LOWER": (lambda: f"{r.choice(self.given)} {r.choice(self.family)}".lower(), "name"), "GIVEN": (lambda: r.choice(self.given), "name"), "FAMILY": (lambda: r.choice(self.family), "name"),
            "KFAM": (lambda: r.choice(self.kana_family if r.random() < 0.6 else KANJI_FAMILY), "name"),
            "KNAME": (lambda: r.choice(self.kana_family) + r.choice("・ ") + r.choice(self.kana_given) if r.random() < 0.7 else r.choice(KANJI_FAMILY) + r.choice(["", " "]) + r.choice(KANJI_GIVEN), "name"),
        }[slot]
        return [(made[0](), made[1])]

    def fill(self, frame: str) -> list[tuple[str, str | None]]:
        """Pieces of text, each with its type or None."""
        out: list[tuple[str, str | None]] = []
        at = 0
        for m in _SLOT.finditer(frame):
            out.append((frame[at : m.start()], None))
            out += self.value(m[1])
            at = m.end()
        return [*out, (frame[at:], None)]

    def snippet(self, frames: list[str]) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        parts: list[tuple[str, str | None]] = []
        if r.random() < 0.55:
            parts += [*self.fill(r.choice(FILLERS)), (r.choice(["\n", " ", "\n"]), None)]
        parts += self.fill(r.choice(frames))
        if r.random() < 0.3:
            parts += [(r.choice(["\n", "\n", " "]), None), *self.fill(r.choice(frames))]
        if r.random() < 0.55:
            parts += [(r.choice(["\n", " "]), None), *self.fill(r.choice(FILLERS))]
        out, truth, at = [], [], 0
        for text, kind in parts:
            if kind:
                truth.append((at, at + len(text), kind))
            out.append(text)
            at += len(text)
        return "".join(out), truth


def frames_of(which: str) -> list[str]:
    """The frames of a set: every fifth calibrates, every fifth tests, the others train."""
    want = {"train": (0, 1, 2), "calibrate": (3,), "test": (4,)}[which]
    return [f.replace("\\n", "\n").replace("\\t", "\t") for i, f in enumerate(FRAMES) if i % 5 in want]


def snippets(n: int, seed: int = 11, which: str = "train") -> tuple[list[str], list[list[tuple[int, int, str]]], list[tuple[str, str]]]:
    """`n` texts from one set of frames, their true (start, end, type), and the known (name, type); the same for the same arguments."""
    w = _Writer(seed)
    frames = frames_of(which)
    made = [w.snippet(frames) for _ in range(n)]
    return [t for t, _ in made], [x for _, x in made], w.known
