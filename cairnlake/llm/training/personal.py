"""Train the tagger of personal information on labelled spans.

python -m cairnlake.llm.training.personal PAGES.parquet DOCUMENTS.parquet SECONDS [TABLE.parquet:column ...]

Items are invented and stand between words drawn by chance or within
sentences of the pages and documents given (at most ``MAX_TEXTS`` texts), so
every span is known.  A part of the names are words of ``patient_name``.  Columns
named at the end give questions and answers without items.  Training goes on
from the stored weights if they have the same shape.
"""

from __future__ import annotations

import random
import re
import sys
import time
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from cairnlake.llm.personal import KINDS, SYMBOLS, TAGS, codes, lstm, scores

MAX_TEXTS = 20_000
HIDDEN, EMBED = 40, 20
# Names, places and phrases below are made up for training; none is taken from a table that is read later.
_GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Joseph Jessica Thomas Sarah Karen Lisa Nancy Daniel Betty Matthew Sandra Mark Ashley Paul Emily Andrew Donna Joshua "
    "Michelle Kenneth Carol Kevin Amanda Brian George Melissa Timothy Deborah Ronald Laura Jason Rebecca Ryan Sharon Jacob Cynthia Gary Kathleen Amy Eric Angela Anna Stephen Brenda Larry Pamela Justin Nicole Scott Samuel "
    "Hans Ingrid Jürgen Heike Lukas Sabine Pierre Amélie Luc Chloé José Lucía Carlos Carmen Javier Pilar Giulia Marco Paolo Chiara Olga Dmitri Svetlana Ivan Piotr Agnieszka Ayşe Mehmet Fatima Omar Layla Hassan Aisha Wei Mei Hiroshi Yuki Priya Raj Anjali Sanjay Kwame Amara Chidi Ngozi"
).split()
_FAMILY = (
    "Smith Johnson Williams Brown Jones Garcia Miller Davis Rodriguez Martinez Hernandez Lopez Gonzalez Wilson Anderson Thomas Taylor Moore Jackson Martin Lee Perez Thompson White Harris Sanchez Clark Ramirez Lewis Robinson "
    "Walker Young Allen King Wright Scott Torres Nguyen Hill Flores Green Adams Nelson Baker Hall Rivera Campbell Mitchell Carter Roberts Gomez Phillips Evans Turner Diaz Parker Cruz Edwards Collins Reyes Stewart Morris Morales "
    "Murphy Cook Rogers Gutierrez Ortiz Morgan Cooper Peterson Bailey Reed Kelly Howard Ramos Kim Cox Ward Richardson Müller Schmidt Schneider Fischer Weber Becker Dubois Moreau Lefèvre Rossi Bianchi Ferrari Kowalski Novák Ivanova Petrov Yılmaz Demir Khan Ahmed Hussein Chen Wang Tanaka Sato Patel Sharma Okafor Mensah"
).split()
_SYLL = ("ba", "cor", "dell", "esh", "fin", "gor", "ham", "ist", "jun", "kel", "lor", "mun", "nor", "os", "pran", "qua", "rud", "sta", "tev", "ub", "vor", "wil", "xan", "yor", "zem", "lia", "na", "ric", "ta", "vi")
_STREET = "Main Oak Maple Park Church High Station King Queen Lake Hill River Spring Cedar Washington Lincoln Mill Bridge Garden Orchard Meadow School College Market North West Sunset Pine Chestnut Victoria Albert Canal Harbour Forest Valley".split()
_TOWNWORD = "Spring River Lake Wood Green Fair Clear Bright Stone Brook Oak Ash Elm West East North South New Old Long High Mid Rock Sand Glen Hart Fox Deer Swan".split()
_TOWNEND = "ville field ton ham ford wood dale burg haven view side mouth bury ley worth stead minster pool".split()
_KINDS_OF_WAY = ("Lane", "Street", "St.", "St", "Avenue", "Ave", "Ave.", "Road", "Rd", "Rd.", "Drive", "Dr", "Dr.", "Way", "Court", "Ct", "Ct.", "Close", "Terrace", "Boulevard", "Blvd", "Place", "Square", "Crescent", "Parkway", "Gardens")
_EPONYMS = "Crohn Parkinson Apgar Foley Doppler Holter Bell Babinski Hashimoto Graves Addison Cushing Alzheimer Wilson Marfan Barrett Romberg Murphy McBurney Valsalva Glasgow Hodgkin Kaposi Paget Raynaud Tourette Turner Trendelenburg Baker Braden Norton".split()
_NOUNS = ("disease", "syndrome", "sign", "test", "score", "scale", "catheter", "cyst", "palsy", "maneuver", "study", "monitor", "thyroiditis", "position", "lymphoma")
_THINGS = ("lot", "batch", "order", "order no.", "invoice", "serial", "serial no.", "s/n", "device", "model", "catalogue no.", "part no.", "accession", "accession no.", "specimen", "barcode", "NDC", "CPT", "ICD", "room", "bed", "ward", "version", "release", "document", "doc", "ticket", "case form", "reference", "ref", "ref.", "tracking", "code", "codes", "protocol", "study", "bag no.", "pump", "kit", "asset", "form", "job", "receipt", "lot number", "report no.", "file", "requisition")
_LABELS = ("SSN", "SSN:", "ssn", "social security number", "social security no.", "social", "national id", "ID card", "identity card no.", "identity number", "citizen no.", "NHS no.", "NHS number", "health service no.", "health card", "health insurance number", "passport", "passport no.", "passport number:", "member ID", "member no.", "member", "policy number", "policy no.", "insurance id", "insurance no.", "subscriber", "MRN", "MRN:", "mrn", "medical record number", "record no.", "record number", "hospital number", "hospital no.", "patient id", "patient number", "patient no.", "chart no.", "Medicare", "Medicaid id", "tax id", "CNIC", "personal number", "Versichertennummer", "Patientennummer", "DNI", "número de historia")
_LEADS = {
    "name": ("", "", "my name is ", "I am ", "this is ", "for ", "For ", "regarding ", "re: ", "about ", "patient ", "Patient ", "seen with ", "spoke to ", "according to ", "as told by ", "written by ", "cc ", "to ", "from ", "Dear ", "Hello ", "thanks, ", "ask ", "tell ", "sister ", "her husband ", "caregiver ", "guardian: ", "reviewed by Dr. ", "Dr ", "Dr. ", "Mr. ", "Mrs. ", "Ms ", "Prof. ", "Nurse ", "and ", "with ", "both ", "does ", "is ", "did ", "contact ", "name: ", "next of kin ", "the son ", "Frau ", "Herr ", "Señora ", "von ", "para ", "signed, ", "call ", "summary of ", "show "),
    "email": ("", "email ", "e-mail: ", "mail to ", "write to ", "send it to ", "at ", "via ", "reply to ", "cc: ", "my address is ", "contact: ", "forward to ", "and ", "not ", "use ", "Email: ", "por correo a ", "an "),
    "phone": ("", "phone ", "phone: ", "tel. ", "Tel: ", "call ", "call me on ", "at ", "mobile ", "cell ", "fax ", "fax: ", "number is ", "reach me under ", "text ", "ring ", "dial ", "on ", "unter ", "al teléfono ", "contact no. ", "Home phone "),
    "address": ("", "I live at ", "lives at ", "address: ", "Address ", "home address ", "residing at ", "mail it to ", "delivered to ", "sent to ", "moved to ", "at ", "from ", "our house is at ", "ship to ", "resides at ", "wohnhaft ", "vive en ", "billing address: ", "the letter went to ", "visit at "),
}
_TAILS = {
    "name": ("", "", ".", "?", "!", " asked for a copy", " is my mother", " will visit", " has an appointment", "'s results", "’s chart", " came in today", " please", " and family", " wants to know", ", please", " (daughter)", " on the ward", " at noon", " again", " takes it twice", " signed the form", " agreed", ":", ",", " said so"),
    "email": ("", ".", ";", " please", ", thanks", " today", " is no longer used", " bounced", "?"),
    "phone": ("", ".", ";", " after five", " please", ", any time", " (work)", " is wrong", "?", " tomorrow"),
    "address": ("", ".", ";", " since May", ", please", " until further notice", " is out of date", "?", " as before"),
    "id_no": ("", ".", ";", "?", " please", ", thanks", " is mine", " was entered twice", " on file", ":"),
}
_FILL = ("Please check the file.", "Thank you.", "What was the result?", "Can you confirm?", "It hurts again.", "See the note.", "Any update?", "ok", "Bitte um Rückruf.", "Gracias.", "Is that normal?", "I need the report.", "When is the next visit?", "Compare both.")


class Maker:
    def __init__(self, r: random.Random, names: list[str], clean: list[str]):
        self.r, self.clean, self.plain, self.drugs = r, clean, [], ["Aspirin"]
        given, family = set(), set()
        for n in names:
            f, _, g = n.partition(",") if "," in n else (n.split()[-1], "", " ".join(n.split()[:-1]))
            given |= {w for w in g.split() if len(w) > 2}
            family |= {w for w in f.split("-") if len(w) > 3}
        self.given, self.family = sorted(given) or list(_GIVEN), sorted(family) or list(_FAMILY)

    def invented(self) -> str:
        return "".join(self.r.choice(_SYLL) for _ in range(self.r.randint(2, 4))).capitalize()

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def one_given(self) -> str:
        x = self.r.random()
        return self.r.choice(self.given) if x < 0.5 else self.r.choice(_GIVEN) if x < 0.75 else self.invented()

    def one_family(self) -> str:
        r = self.r
        y = r.random()
        x = r.choice(self.family) if y < 0.5 else r.choice(_FAMILY) if y < 0.75 else self.invented() + r.choice(("", "", "son", "mann", "ez", "ova", "ski", "berg", "ini", "well"))
        y = r.random()
        if y < 0.06:
            x = r.choice(("O'", "O’", "Mc", "Mac", "D'")) + x
        elif y < 0.14:
            x = r.choice(("van ", "de ", "von ", "della ", "al-", "van den ", "St. ", "du ", "El ", "bin ")) + x
        elif y < 0.21:
            x += "-" + r.choice(_FAMILY)
        return x

    def name(self) -> str:
        r = self.r
        g, f = self.one_given(), self.one_family()
        x = r.random()
        n = (
            f"{g} {f}" if x < 0.46 else f"{g} {self.one_given()} {f}" if x < 0.54 else f"{g} {r.choice('ABCDEFGHIJKLMNOPRSTVW')}. {f}" if x < 0.64
            else f"{f}, {g}" if x < 0.74 else f"{g[0]}. {f}" if x < 0.82 else g if x < 0.91 else f
        )
        y = r.random()
        return n.upper() if y < 0.06 else n.lower() if y < 0.13 else n

    def email(self) -> str:
        r = self.r
        g, f = re.sub(r"\W", "", self.one_given().lower()), re.sub(r"\W", "", self.one_family().lower())
        parts = [r.choice((g, g[0], f, f[:5], self.invented().lower())) for _ in range(r.choice((1, 2, 2, 2)))]
        local = r.choice((".", "_", "-", "")).join(parts) + (self.digits(r.randint(1, 4)) if r.random() < 0.3 else "") + (f"+{r.choice(('news', 'health', 'x'))}{self.digits(r.randint(0, 2))}" if r.random() < 0.1 else "")
        host = ".".join([r.choice(("mail", "post", self.invented().lower(), f"{self.invented().lower()}-{r.choice(('net', 'care', 'web'))}", "inbox")) for _ in range(r.choice((1, 1, 2)))] + [r.choice(("com", "org", "net", "de", "co.uk", "example", "invalid", "test", "edu", "io"))])
        e = local + r.choice(("@",) * 8 + (" @ ", "(at)", "[at]", " (at) ")) + host
        y = r.random()
        return e.upper() if y < 0.08 else e.title() if y < 0.14 else e

    def phone(self) -> str:
        r, d = self.r, self.digits
        sep = r.choice(("-", "-", ".", " ", "/", "", "–"))
        x = r.random()
        if x < 0.18:
            return f"{d(3)}{r.choice('- .')}{d(4)}"
        if x < 0.5:
            area = r.choice((f"({d(3)}) ", f"({d(3)})", d(3) + sep, d(3) + sep))
            return r.choice(("", "", "+1 ", "1-", "+1", "001 ")) + area + d(3) + (sep or r.choice(("", "-"))) + d(4)
        if x < 0.75:
            return r.choice(("+", "00")) + str(r.choice((44, 49, 33, 34, 39, 92, 91, 61, 81, 7, 351, 48))) + r.choice((" ", "", " (0)", "-")) + r.choice((" ", "", "-")).join(d(r.randint(2, 4)) for _ in range(r.randint(2, 4)))
        return "0" + r.choice((" ", "", "-", "/")).join(d(r.randint(2, 4)) for _ in range(r.randint(3, 4)))

    def id_no(self) -> tuple[str, str]:
        r, d = self.r, self.digits
        letters = "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(r.randint(1, 4)))
        sep = r.choice(("-", "-", " ", ""))
        number = r.choice((
            lambda: sep.join((d(3), d(2), d(4))), lambda: f"{d(5)}-{d(7)}-{d(1)}", lambda: r.choice((" ", "", "-")).join((d(3), d(3), d(4))), lambda: letters + d(r.randint(6, 9)), lambda: f"MRN-{r.choice(('19', '20'))}{d(2)}-{d(r.randint(4, 8))}", lambda: d(r.randint(7, 16)),
            lambda: f"{letters}-{d(2)}-{d(r.randint(4, 7))}-{d(2)}", lambda: f"{letters}-{d(r.randint(5, 9))}", lambda: f"{d(2)}-{d(7)}", lambda: letters + " " + d(r.randint(6, 9)), lambda: "-".join(d(r.randint(2, 4)) for _ in range(r.randint(3, 4))),
        ))()
        return r.choice(_LABELS), number

    def town(self) -> str:
        r = self.r
        return r.choice(("", "", "", "New ", "Port ", "St. ", "Bad ", "San ")) + (r.choice(_TOWNWORD) + r.choice(_TOWNEND) if r.random() < 0.5 else self.invented() + r.choice(("", "", r.choice(_TOWNEND))))

    def way(self) -> str:
        r = self.r
        return r.choice(_STREET) if r.random() < 0.4 else self.invented() + r.choice(("", "", r.choice(_TOWNEND)))

    def address(self) -> str:
        r, d = self.r, self.digits
        x, n = r.random(), str(r.randint(1, 9999 if r.random() < 0.5 else 99))
        if x < 0.1:
            a = f"{r.choice(('P.O. Box', 'PO Box', 'Box', 'Postfach'))} {n}, {self.town()}" + r.choice(("", f" {d(5)}", f", {d(5)}"))
        elif x < 0.19:
            a = f"{r.choice(('Calle', 'Avenida', 'Plaza', 'C/'))} {r.choice(('', 'de ', 'del '))}{self.way()} {n[:3]}, {d(5)} {self.town()}"
        elif x < 0.25:
            a = f"{n[:3]}{r.choice((' ', ', '))}{r.choice(('rue', 'avenue', 'boulevard', 'place'))} {r.choice(('', 'de ', 'du ', 'des '))}{self.way()}, {d(5)} {self.town()}"
        elif x < 0.36:
            a = f"{self.way()}{r.choice(('weg', 'straße', 'strasse', 'str.', 'gasse', 'allee', 'platz', 'ring'))} {n[:3]}{r.choice(('', '', 'a', 'b'))}, {d(5)} {self.town()}"
        elif x < 0.48:
            a = f"{r.choice(('Flat', 'Apartment', 'Unit'))} {n[:2]}{r.choice(('', '', 'A', 'B'))}, {r.randint(1, 199)} {self.way()} {r.choice(_KINDS_OF_WAY)}, {self.town()}" + r.choice(("", f" {r.choice('ABELNSW')}{d(1)} {d(1)}{r.choice('ABDEFGH')}{r.choice('JLNPQR')}"))
        else:
            a = f"{n} {r.choice(('', '', '', 'N. ', 'South ', 'E ', 'W. '))}{self.way()} {r.choice(_KINDS_OF_WAY)}"
            if r.random() < 0.35:
                a += r.choice((", ", " ")) + r.choice((f"Apt {d(2)}{r.choice('ABCDE')}", f"Apt. {d(1)}", f"Suite {d(3)}", f"# {d(2)}", f"Unit {d(1)}"))
            if r.random() < 0.65:
                a += f", {self.town()}" + r.choice(("", f", {r.choice('ACFGIKLMNOPTUVW')}{r.choice('ALNKTXYZ')} {d(5)}", f" {d(5)}", f", {r.choice('ACFGIKLMNOPTUVW')}{r.choice('ALNKTXYZ')}"))
        y = r.random()
        return a.lower() if y < 0.08 else a.upper() if y < 0.11 else a

    def decoy(self) -> str:
        """A number, a street-like or a name-like word that is no item."""
        r, d = self.r, self.digits
        sep = r.choice(("-", "-", ".", "/", " ", ""))
        number = sep.join(d(r.randint(1, 5)) for _ in range(r.randint(1, 3))) if r.random() < 0.7 else r.choice("ABCDEFGHJKLMNPRSTVXZ") + d(r.randint(1, 8))
        return r.choice((
            lambda: f"{r.choice(_THINGS)} {number}", lambda: f"{r.choice(_THINGS).capitalize()}: {number}", lambda: f"{r.choice(_THINGS)} {number}", lambda: f"{r.choice(_THINGS)} {d(3)}-{d(3)}-{d(4)}", lambda: f"{r.choice(_THINGS)} #{number}", lambda: f"{r.choice(('rates of', 'counts', 'values', 'settings', 'readings'))} {d(3)}-{d(3)}-{d(4)} {r.choice(('on the monitor', 'were stored', 'today'))}",
            lambda: f"{r.choice(('the', 'a', 'positive'))} {r.choice(_EPONYMS)} {r.choice(_NOUNS)}", lambda: f"{d(3)}/{d(2)} mmHg", lambda: f"{d(2)}.{d(1)} {r.choice(('mg/dL', 'mmol/L', 'g', '%', 'mcg', 'Fr'))}", lambda: f"{d(3)} {d(3)} {r.choice(('cells', 'units', 'copies', 'steps'))}",
            lambda: f"the {r.choice(_STREET)} {r.choice(('Way', 'Road', 'Street', 'Court', 'Lane'))} {r.choice(('booklet', 'trial', 'protocol', 'programme', 'score', 'cohort'))}", lambda: f"{r.choice((5, 20, 100, 7.5))} mg @ {d(2)}:{d(2)}", lambda: f"at {d(2)}:{d(2)} on {d(2)}/{d(2)}/20{d(2)}", lambda: f"[S{d(1)}]", lambda: f"grade {d(1)} Dr. note", lambda: f"doc-{d(8)}", lambda: f"v{d(1)}.{d(1)}.{d(2)}",
        ))()

    def phrase(self) -> str:
        """A few words of a sentence of the domain."""
        words = self.r.choice(self.clean or _FILL).rstrip(".?! ").split(" ")
        k = self.r.randint(1, 3)
        at = self.r.randrange(max(1, len(words) - k))
        return " ".join(words[at : at + k])

    def drug(self) -> str:
        return self.r.choice(self.drugs)

    def item(self, kind: str) -> list[tuple[str, str | None]]:
        """An item between words that may stand before and behind it."""
        r = self.r
        tail = r.choice(_TAILS[kind]) if r.random() < 0.7 else ""
        if kind == "id_no":
            label, number = self.id_no()
            if r.random() < 0.25:
                return [(r.choice(("", "see ", "See also ", "with ", "(", "against ", "I also see ")) + self.decoy() + tail, None)]
            before = r.choice(("", "", "my ", "with ", "(", "the ", "under ", "his ", "and ", "for "))
            glue = r.choice((" ", " ", ": ", " is ", " #", " = ", " no. "))
            label = label.rstrip(":") if ":" in glue else label
            return [(before + (label[0].upper() + label[1:] if r.random() < 0.2 else label) + glue, None), (number, kind), ((")" if before == "(" else "") + tail, None)]
        lead = r.choice(_LEADS[kind])
        lead = lead.capitalize() if r.random() < 0.3 else lead
        if r.random() < 0.3:  # the same words around what is no item
            x = r.random()
            return [(lead + (self.phrase() if x < 0.5 else self.drug() if x < 0.65 else self.decoy()) + tail, None)]
        value = getattr(self, kind)()
        if kind == "name" and re.search(r"\b(?:Dr|Mr|Mrs|Ms|Prof|Nurse|Frau|Herr|Señora)\.? $", lead) and r.random() < 0.8:
            value = self.one_family()
        return [(lead, None), (value, kind), (tail, None)]

    def compose(self) -> list[tuple[str, str | None]]:
        """Pieces of one text with their kinds."""
        r = self.r
        kinds = ("name", "name", "name", "email", "phone", "id_no", "address")
        x = r.random()
        if x < 0.16 and self.clean:  # a sentence with an item put into it
            words = r.choice(self.clean).split(" ")
            at = r.randint(0, len(words))
            item = self.item(r.choice(kinds))
            o, c = r.choice(((" (", ") "), (", ", ", "), (" ", " "), (" - ", " - ")))
            return [(" ".join(words[:at]) + o, None), *item, (c + " ".join(words[at:]), None)]
        if x < 0.26 and self.clean:  # the patient by name
            s = r.choice(self.clean)
            m = re.match(r"(?:The )?[Pp]atient\b", s)
            s = s[m.end() :] if m else " " + s[0].lower() + s[1:]
            return [(r.choice(("", "", "Mr. ", "Mrs. ", "Patient ")), None), (self.name(), "name"), (r.choice(("", "", ",", "'s chart:", " -")) + s, None)]
        if x < 0.34:
            return [(r.choice(("See ", "Check ", "", "Compare ", "", "Is it ", "under ")) + self.decoy() + r.choice(("", ".", "?", " please", " again")), None)]
        if x < 0.42:
            d = self.drug
            what = r.choice(("dose", "level", "effect", "result", "plan"))
            return [(r.choice((f"Did the {what} of {d()} change?", f"{d()} and {d()} together?", f"**{d()}** {r.randint(1, 90)} mg daily", f"Stop {d()} on {self.digits(2)}/{self.digits(2)}", f"why was {d()} started", f"{d()}: no {what} recorded", f"take {d().lower()} with food")), None)]
        # items in a row
        sep = r.choice((", ", "; ", " / ", " - ", "\n", ". ", " and ", " or ", " ", " | ", ": "))
        out: list[tuple[str, str | None]] = []
        for k, kind in enumerate(r.choice(kinds) for _ in range(r.choice((1, 1, 1, 2, 2, 3, 4)))):
            if k:
                out.append((sep, None))
            out += self.item(kind)
        return out

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        parts: list[tuple[str, str | None]] = []
        if r.random() < 0.05:
            parts.append((r.choice(("🙂 ", "  ", "\n", " ", "- ", "> ")), None))
        for k in range(r.choice((1, 1, 2, 2, 3))):
            if k:
                parts.append((r.choice((" ", " ", "\n", " -- ", ". ")), None))
            x = r.random()
            parts += self.compose() if x < 0.6 else [(r.choice(self.clean), None)] if x < 0.72 else [(r.choice(self.plain or _FILL), None)] if x < 0.93 else [(r.choice(_FILL), None)]
        s, spans = "", []
        for piece, kind in parts:
            if kind:
                spans.append((len(s), len(s) + len(piece), kind))
            s += piece
        x = r.random()
        other = s.lower() if x < 0.08 else s.upper() if x < 0.12 else s
        return other if len(other) == len(s) else s, spans


def tags(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int64)
    for a, z, kind in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:z] = k + 1
        y[a] = k
    return y


def _init(seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    m = lambda a, b: (r.standard_normal((a, b)) * (1 / a) ** 0.5).astype(np.float32)
    p = {"embed": (r.standard_normal((SYMBOLS, EMBED)) * 0.3).astype(np.float32), "out": m(2 * HIDDEN, len(TAGS)), "bias": np.zeros(len(TAGS), np.float32), "move": np.zeros((len(TAGS), len(TAGS)), np.float32), "start": np.zeros(len(TAGS), np.float32)}
    for d in "01":
        p |= {f"w{d}": m(EMBED, 4 * HIDDEN), f"u{d}": m(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
        p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
    return p


def _lstm_back(x, w, u, saved, out, d):
    t, n, hidden = out.shape
    gw, gu, gb, gx = np.zeros_like(w), np.zeros_like(u), np.zeros(4 * hidden, np.float32), np.empty_like(x)
    dh, dc = np.zeros((n, hidden), np.float32), np.zeros((n, hidden), np.float32)
    dz_all = np.empty((t, n, 4 * hidden), np.float32)
    for k in range(t - 1, -1, -1):
        i, f, o, g, before, tc = saved[k]
        h = d[k] + dh
        dc = dc + h * o * (1 - tc * tc)
        dz = dz_all[k]
        dz[:, :hidden] = dc * g * i * (1 - i)
        dz[:, hidden : 2 * hidden] = dc * before * f * (1 - f)
        dz[:, 2 * hidden : 3 * hidden] = h * tc * o * (1 - o)
        dz[:, 3 * hidden :] = dc * i * (1 - g * g)
        dh = dz @ u.T
        dc = dc * f
    flat = dz_all.reshape(-1, 4 * hidden)
    gw = x.reshape(-1, x.shape[2]).T @ flat
    gu = out[:-1].reshape(-1, hidden).T @ dz_all[1:].reshape(-1, 4 * hidden)
    gb = flat.sum(0)
    gx = dz_all @ w.T
    return gw, gu, gb, gx


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def step(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """CRF loss and gradients; sequences of one batch have one length."""
    e = p["embed"][x]
    a_out, a_saved = lstm(e, p["w0"], p["u0"], p["b0"], keep=True)
    eb = np.ascontiguousarray(e[::-1])
    b_out, b_saved = lstm(eb, p["w1"], p["u1"], p["b1"], keep=True)
    h = np.concatenate([a_out, b_out[::-1]], 2)
    s = h @ p["out"] + p["bias"]
    t, n, k = s.shape
    alpha, beta = np.empty_like(s), np.zeros_like(s)
    alpha[0] = p["start"] + s[0]
    move = p["move"]
    for i in range(1, t):
        alpha[i] = _logsum(alpha[i - 1][:, :, None] + move, 1) + s[i]
    for i in range(t - 2, -1, -1):
        beta[i] = _logsum(move[None] + (s[i + 1] + beta[i + 1])[:, None, :], 2)
    z = _logsum(alpha[-1], 1)
    marginal = np.exp(alpha + beta - z[None, :, None])
    rows = np.arange(n)
    gold = p["start"][y[0]] + s[np.arange(t)[:, None], rows, y].sum(0) + move[y[:-1], y[1:]].sum(0)
    g: dict[str, np.ndarray] = {}
    ds = marginal.copy()
    ds[np.arange(t)[:, None], rows, y] -= 1
    ds /= n
    gm = np.zeros_like(move)
    for i in range(0, t - 1, 16):
        j = min(i + 16, t - 1)
        pair = np.exp(alpha[i:j, :, :, None] + move + (s[i + 1 : j + 1] + beta[i + 1 : j + 1])[:, :, None, :] - z[None, :, None, None])
        gm += pair.sum((0, 1))
    np.add.at(gm, (y[:-1].ravel(), y[1:].ravel()), -1)
    g["move"], g["start"] = gm / n, ds[0].sum(0)
    g["out"], g["bias"] = h.reshape(-1, h.shape[2]).T @ ds.reshape(-1, k), ds.sum((0, 1))
    dh = ds @ p["out"].T
    half = a_out.shape[2]
    g["w0"], g["u0"], g["b0"], ge = _lstm_back(e, p["w0"], p["u0"], a_saved, a_out, dh[:, :, :half])
    g["w1"], g["u1"], g["b1"], gb = _lstm_back(eb, p["w1"], p["u1"], b_saved, b_out, np.ascontiguousarray(dh[::-1][:, :, half:]))
    ge = ge + gb[::-1]
    g["embed"] = np.zeros_like(p["embed"])
    np.add.at(g["embed"], x.ravel(), ge.reshape(-1, ge.shape[2]))
    return float((z - gold).mean()), g


def batches(maker: Maker, size: int, length: int):
    """Endless batches of windows of one length; texts are joined by line feeds."""
    while True:
        xs, ys = np.zeros((length, size), np.int64), np.zeros((length, size), np.int64)
        for j in range(size):
            s, spans = maker.text()
            while len(s) < length and maker.r.random() < 0.5:
                more, m = maker.text()
                spans += [(a + len(s) + 1, z + len(s) + 1, k) for a, z, k in m]
                s += "\n" + more
            c, y = codes(s)[:length], tags(len(s), spans)[:length]
            xs[: len(c), j], ys[: len(c), j] = c, y
        yield xs, ys


_OWN: dict = {}


def _begin(names: list[str], clean: list[str], drugs: list[str], plain: list[str]) -> None:
    import os

    maker = Maker(random.Random(os.getpid()), names, clean)
    maker.drugs, maker.plain = drugs, plain
    _OWN["maker"], _OWN["sources"] = maker, {}


def _worker(args):
    p, size, length = args
    source = _OWN["sources"].setdefault(length, batches(_OWN["maker"], size, length))
    return step(p, *next(source))


def train(names: list[str], clean: list[str], drugs: list[str], plain: list[str], seconds: float, begin: dict[str, np.ndarray] | None = None, seed: int = 1, workers: int = 8) -> dict[str, np.ndarray]:
    from multiprocessing import Pool

    p = begin or _init(seed)
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    began, n = time.time(), 0
    with Pool(workers, _begin, (names, clean, drugs, plain)) as pool:
        while (spent := (time.time() - began) / seconds) < 1:
            n += 1
            length = 96 if spent < (0.6 if begin is None else 0.3) else 176
            got = pool.map(_worker, [(p, 32, length)] * workers, chunksize=1)
            rate = (6e-3 if begin is None else 4e-3) * min(1, n / 30) * (1 - spent) + 1e-5
            for k in p:
                g = np.mean([x[1][k] for x in got], 0)
                g = g / max(1.0, float(np.abs(g).max()) / 1.0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
            if n % 50 == 0:
                print(n, f"{time.time() - began:.0f}s", "loss", round(float(np.mean([x[0] for x in got])), 3), flush=True)
    return p


def held_out(p: dict[str, np.ndarray], maker: Maker, count: int = 600) -> dict[str, tuple[int, int, int]]:
    from cairnlake.llm.personal import find

    made = [maker.text() for _ in range(count)]
    out = {k: [0, 0, 0] for k in KINDS}
    for (_, spans), found in zip(made, find([s for s, _ in made], p)):
        got = {(a, k) for a, _, k in found}
        true = {(a, k) for a, _, k in spans}
        for a, k in got:
            out[k][1] += 1
        for a, k in true:
            out[k][2] += 1
            out[k][0] += (a, k) in got
    return {k: tuple(v) for k, v in out.items()}


def sources(pages: str, documents: str) -> tuple[list[str], list[str], list[str]]:
    """Names of the pages' patients, sentences of pages and documents, and the words in them that stand like names of drugs."""
    t = pq.read_table(pages, columns=["patient_name", "page_content"]).slice(0, MAX_TEXTS)
    names = sorted({n for n in t.column(0).to_pylist() if n and n.strip()})
    texts = [x for x in t.column(1).to_pylist() if x and "\n" not in x[:400]] + [x for x in pq.read_table(documents, columns=["text"]).slice(0, MAX_TEXTS).column(0).to_pylist() if x]
    clean = sorted({s for x in texts for s in re.split(r"(?<=[.?!])\s+", x) if 20 < len(s) < 200})
    drugs = sorted({w for x in texts for w in re.findall(r"(?<=[a-z] )[A-Z][a-z]{5,}(?= \d)", x)})
    return names, clean, drugs


_ASKED_OF = re.compile(r"^\s*(?:for patient [^?\n]*?\)[,:]\s*|patient [^:?\n]*\([^)]*\):\s*)", re.I)


def plain_sentences(specs: list[str]) -> list[str]:
    """Questions without the patient they name at their head, and answers, of columns that state nothing personal."""
    out = set()
    for spec in specs:
        path, column = spec.split(":")
        for t in pq.read_table(path, columns=[column]).slice(0, MAX_TEXTS).column(0).to_pylist():
            for s in re.split(r"(?<=[.?!])\s+|\n", _ASKED_OF.sub("", t or "")):
                if 4 < len(s) < 160 and "@" not in s and "MRN" not in s and "atient " not in s[:12]:
                    out.add(s)
    return sorted(out)


if __name__ == "__main__":
    names, clean, drugs = sources(sys.argv[1], sys.argv[2])
    plain = plain_sentences(sys.argv[4:])
    print(len(names), "names", len(clean), "sentences", len(drugs), "drugs", len(plain), "questions")
    r = random.Random(2)
    for x in (names, clean, plain):
        r.shuffle(x)
    k = len(names) * 4 // 5
    target = Path(__file__).parents[1] / "models/personal.npz"
    stored = {k: v.astype(np.float32) for k, v in np.load(target).items()} if target.exists() else None
    begin = stored if stored is not None and stored["embed"].shape == (SYMBOLS, EMBED) and stored["u0"].shape[0] == HIDDEN else None
    p = train(names[:k], clean[: len(clean) // 2], drugs, plain[::2], float(sys.argv[3]), begin)
    maker = Maker(random.Random(77), names[k:], clean[len(clean) // 2 :])
    maker.drugs, maker.plain = drugs, plain[1::2]
    print(held_out(p, maker, 1500))
    np.savez_compressed(target, **{k: v.astype(np.float16) for k, v in p.items()})
