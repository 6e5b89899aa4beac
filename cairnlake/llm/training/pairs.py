"""Train the classifier of broken pairs on synthetic defects of sound pairs.

python -m cairnlake.llm.training.pairs A.parquet:question:answer B.parquet:question:reply

At most ``MAX_PAIRS`` pairs are read.  Sound seed pairs are those that end like
a whole answer in the question's language; every defect is then made of them.
"""

from __future__ import annotations

import random
import re
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq

from cairnlake.llm.pairs import BUCKETS, DEFECTS, bare, is_empty, language_scores, script, vector, word_codes

MAX_PAIRS = 20_000
# Phrases below are put together by chance from parts; none is an answer of a table that is read later.
_THINGS = ("the operation", "your dosage", "the tumour marker", "this person", "legal matters", "the prognosis", "insulin", "the X-ray", "potassium", "another patient", "the waiting list", "pain relief", "the lab sheet", "side effects", "her treatment", "the ultrasound", "blood thinners", "the allergy", "iron levels", "the discharge")


def _refusal(r: random.Random) -> str:
    x, c = r.choice(_THINGS), r.choice
    why = c(("", "", "", " for reasons of privacy", " because of our rules", " as it could do harm", " under the terms of use", " since I am only a program", " without authorisation", " for ethical reasons", " due to safety concerns"))
    verb = c(("help with", "assist with", "answer", "comment on", "discuss", "give advice on", "provide", "share", "respond to", "talk about", "disclose", "look up", "reveal", "interpret", "process", "give out", "say anything about", "address"))
    what = c((x, x, "that", "this", "it", "this request", "the question", "such questions", f"information on {x}", f"details of {x}", "confidential data", "medical advice", "what you ask"))
    can = c(("cannot", "can't", "can not", "am not able to", "am unable to", "won't", "will not", "may not", "must not", "am not allowed to", "am not permitted to", "am not authorised to", "do not wish to", "have to refuse to", "must decline to", "have been told not to", "don't feel able to", "would rather not", "am not in a position to", "was asked not to"))
    sorry = c(("", "", "", "Sorry, ", "I'm sorry, ", "I am sorry, but ", "Apologies, ", "My apologies; ", "Unfortunately, ", "Regrettably, ", "I'm afraid ", "Thank you for asking, but ", "Please understand that "))
    who = c(("", "", "", "As an assistant, ", "As an AI, ", "As a computer program, ", "Being a chatbot, "))
    forms = (
        lambda: f"{sorry}{who}I {can} {verb} {what}{why}.",
        lambda: f"{sorry}I {can} {verb} {what}{why}. {c(('Please ask your doctor.', 'Kindly contact the clinic.', 'A nurse may know more.', 'Try another question.', 'Consult a professional.', 'Is there anything else?'))}",
        lambda: f"{c(('This', 'That', 'The question', 'Your request', 'Such a request', 'This topic'))} {c(('cannot be answered', 'is outside my scope', 'is beyond what I may say', 'goes against my instructions', 'is not something I can do', 'has to be refused', 'was declined', 'is blocked', 'is off limits', 'may not be discussed', 'cannot be processed', 'violates our policy'))}{why}.",
        lambda: f"No {c(('answer', 'comment', 'reply', 'information', 'statement', 'opinion', 'details'))} {c(('can be given', 'will be given', 'may be provided', 'is possible', 'is allowed here'))}{why}.",
        lambda: f"{c(('My rules', 'My instructions', 'The guidelines', 'Our policies', 'Safety rules', 'The operator'))} {c(('forbid', 'do not allow', 'prohibit', 'prevent', 'keep me from'))} {c(('answering', 'sharing', 'discussing', 'commenting on', 'giving out', 'talking about'))} {what}.",
        lambda: f"{c(('Refused', 'Denied', 'Rejected', 'Access denied', 'Blocked', 'Not permitted', 'Declining'))}{c(('.', ': not allowed.', '. Restricted content.', ' by rule.', f' - {x}.', ': confidential.'))}",
        lambda: f"I {c(('refuse', 'decline', 'prefer not', 'am programmed not', 'would have'))} to {verb} {what}{why}{'' if r.random() < 0.8 else ' at all'}.",
        lambda: c(("Lo lamento, pero no me es posible responder a eso.", "No estoy autorizado a hablar de este asunto.", "No puedo dar esa información.", "Leider darf ich dazu nichts sagen.", "Das kann ich nicht beantworten.", "Ich bin nicht befugt, darüber Auskunft zu geben.", "Désolé, je ne suis pas autorisé à en parler.", "Je ne peux pas donner ce renseignement.", "Mi dispiace, non posso rispondere.", "Não posso responder a essa pergunta.", "Lamento, não estou autorizado a falar disso.")),
    )
    forms += (
        lambda: f"{(why.strip() or 'for reasons I may not give').capitalize()}{c((', ', ' '))}{c(('nothing', 'no word', 'no more', 'no advice'))} {c(('may be said', 'is given', 'is available', 'can be offered'))} {c(('on', 'about', 'regarding'))} {what}.",
        lambda: f"{c(('It', 'That', 'This', 'What you ask'))} {c(('lies', 'goes', 'is', 'falls'))} {c(('beyond', 'outside', 'outside of'))} {c(('what I can say', 'the things I may tell', 'my remit', 'what this service offers', 'the limits set for me', 'anything I could answer'))}{why}.",
    )
    t = c(forms + forms[:2])()
    return t[0].upper() + t[1:]


def _short(r: random.Random) -> str:
    """A sound answer that is short, or that speaks of refusing without refusing."""
    c, x = r.choice, r.choice(_THINGS)
    number = f"{r.randint(1, 400)}" + c(("", f".{r.randint(0, 9)}"))
    date = f"{r.randint(1, 12):02}/{r.randint(1, 28):02}" + c(("", f"/{r.choice(('2024', '2025', '25'))}"))
    cite = c(("", "", f" [S{r.randint(1, 9)}]", f" [{r.randint(1, 9)}]"))
    drug = "".join(c(("Tra", "mol", "vi", "zep", "ca", "dor", "lin", "ex")) for _ in range(3)).capitalize()
    word = c(("stable", "normal", "worse", "better", "unchanged", "resolved", "mild", "severe", "negative", "positive", "raised"))
    forms = (
        lambda: number + cite, lambda: f"{number} {c(('mg', 'mmol/L', '%', 'days', 'bpm', 'kg'))}{cite}", lambda: date + cite, lambda: c(("Yes", "No", "Twice", "Never", "Both", "Neither", "None", "Unknown", "Not recorded", "Normal", "Not mentioned", "Left side", "Once daily")) + c((".", "", cite)), lambda: f"{drug} {number} mg{cite}",
        lambda: f"{c(('Yes', 'No'))}, {x}{cite}", lambda: f"{word.capitalize()} since {date}", lambda: f"{r.randint(90, 180)}/{r.randint(50, 99)}{cite}", lambda: f"{number} on {date}, {number} on {date}", lambda: f"{x[0].upper()}{x[1:]} and {drug}", lambda: f"By {date}", lambda: f"With {drug}", lambda: f"{x}, {drug}, {word}", lambda: f"Because of {x}", lambda: f"From {number} to {number}",
        lambda: f"The chart does not say {c(('when', 'why', 'who', 'whether'))} {x} {c(('began', 'ended', 'was ordered', 'was seen'))}{cite}.", lambda: f"There is no entry about {x}{cite}.", lambda: f"Nothing about {x} is written down{cite}.", lambda: f"No, {x} is not mentioned{cite}.",
        lambda: f"{c(('She', 'He', 'The family', 'The patient', 'The husband'))} {c(('refused', 'declined', 'did not want', 'was not able to attend', 'could not tolerate', 'was not allowed'))} {x} on {date}{cite}.", lambda: f"The {c(('surgeon', 'doctor', 'ward', 'insurer'))} {c(('apologised for', 'was sorry about', 'refused to pay for', 'would not approve'))} {x}{cite}.",
        lambda: f"1. {x}\n2. {drug}\n3. {word} with {x}", lambda: f"These were noted:\n- {x}\n- {drug} {number} mg\n- {drug} was kept at {number} mg{cite}",
    )
    return c(forms)()


_FOREIGN_PARTS = {
    "ru": (("Больной", "Пациентка", "Врач", "Анализ"), ("получал лечение", "показал норму", "отметила улучшение", "был выписан домой"), ("в марте", "после операции", "без осложнений", "по результатам обследования")),
    "zh": (("患者", "医生", "检查结果", "家属"), ("认为病情好转", "显示正常", "已经停药", "建议复查"), ("，没有不适。", "，需要观察。", "，时间是三月。", "。")),
    "ur": (("مریض", "ڈاکٹر", "ٹیسٹ"), ("کی حالت بہتر ہے", "نے دوا روک دی", "کا نتیجہ ٹھیک تھا"), ("اور کوئی شکایت نہیں", "مارچ میں", "آپریشن کے بعد")),
    "ar": (("المريض", "الطبيب", "الفحص"), ("أوقف الدواء", "أظهر تحسنا", "كان طبيعيا"), ("بعد العملية", "في الشهر الماضي", "دون مضاعفات")),
    "pt": (("O paciente", "A médica", "O exame", "A família"), ("não tinha queixas", "mostrou uma melhora", "suspendeu o remédio", "foi para casa"), ("depois da cirurgia", "em março", "sem outras queixas", "por causa de febre")),
    "it": (("Il malato", "La dottoressa", "L'esame", "Il medico"), ("ha mostrato un miglioramento", "non aveva dolori", "ha tolto il farmaco", "è tornato a casa"), ("dopo l'intervento", "a marzo", "senza altri disturbi", "per la febbre")),
    "nl": (("De zieke", "De arts", "Het onderzoek"), ("had geen klachten", "is gestopt met het middel", "was weer normaal"), ("na de operatie", "in maart", "zonder problemen")),
    "pl": (("Chory", "Lekarka", "Wynik"), ("nie miał dolegliwości", "odstawiła lek", "był w normie"), ("po zabiegu", "w marcu", "bez powikłań")),
    "es": (("El enfermo", "La doctora", "La prueba", "El equipo"), ("no tenía molestias", "dejó la medicina", "salió normal", "mejoró mucho"), ("después de la operación", "en marzo", "sin otros problemas", "por la fiebre")),
    "de": (("Der Kranke", "Die Ärztin", "Der Befund", "Das Team"), ("hatte keine Beschwerden", "setzte das Mittel ab", "war wieder normal", "blieb stabil"), ("nach der Operation", "im März", "ohne weitere Probleme", "wegen Fieber")),
    "fr": (("Le malade", "La doctoresse", "L'examen", "L'équipe"), ("n'avait pas de douleurs", "a arrêté le médicament", "était normal", "va beaucoup mieux"), ("après l'opération", "en mars", "sans autre problème", "à cause de la fièvre")),
    "en": (("The patient", "The doctor", "The test", "Her family"), ("had no complaints", "stopped the drug", "was back to normal", "felt much better"), ("after surgery", "in March", "without other problems", "because of a fever")),
}


def _foreign(r: random.Random, own: str) -> str:
    k = r.choice([x for x in _FOREIGN_PARTS if x != own])
    a, b, c = (r.choice(p) for p in _FOREIGN_PARTS[k])
    t = a + b + c if k == "zh" else f"{a} {b} {c}."
    if r.random() < 0.4:
        a, b, c = (r.choice(p) for p in _FOREIGN_PARTS[k])
        t += a + b + c if k == "zh" else f" {a} {b} {c}, {r.randint(1, 90)}.{r.randint(0, 9)} ({r.randint(1, 12):02}/{r.randint(1, 28):02})."
    return t[:-1] + f" [S{r.randint(1, 9)}]." if r.random() < 0.6 and t.endswith(".") else t


def _sound(q: str, a: str) -> bool:
    if is_empty(a) or len(a) < 25 or a.rstrip()[-1] not in ".]" or bare(q) in bare(a):
        return False
    if re.search(r"\b(?:sorry|cannot|unable|declin|refus|guideline|polic|apolog|can't|won't|not (?:permitted|allowed|able|appropriate)|no puedo|leider|désolé|dispiace)", a, re.I):
        return False
    lq, la = language_scores(q), language_scores(re.sub(r'"[^"]*"', " ", a))
    return script(q) == script(re.sub(r"\b[A-Z][a-z]{4,}\b", " ", a)) and max(lq, key=lq.__getitem__) == max(la, key=la.__getitem__)


def _cut(a: str, r: random.Random) -> str:
    body = re.sub(r"\s*(\[[A-Z]?\d+\])+[.。]?\s*$", "", a)
    at = r.randint(min(6, len(body) // 2), max(7, len(body) - 2))
    t = body[:at]
    if r.random() < 0.15:
        t = a[: max(3, len(a) - r.randint(1, 3))] if a.rstrip().endswith("]") else t
    x = r.random()
    return t + "..." if x < 0.12 else t + "…" if x < 0.24 else t + " " if x < 0.3 else t.rstrip() + "" if x < 0.9 else t.rstrip() + " and"


def _copied(q: str, r: random.Random) -> str:
    x = re.sub(r"^For patient [^)]*\), ", "", q) if r.random() < 0.7 else q
    return r.choice((
        x, x.upper(), x.lower(), "  " + x.replace("?", " ?"), x.rstrip("?."), f"{x}\n{x}", f"{x}\n{x}", f"{q}\n{q}", f"{x} {x}", f"Q: {x}", f"You asked: {x}", f"> {x}", f"Question: {x}", x.rstrip("?.") + "...", x.rstrip("?") + ".", x[:1].upper() + x[1:], f'"{x}"', f"**{x}**",
    ))


def _list(r: random.Random, parts: list[str]) -> str:
    """A sound list: a mark a line, with or without stops, below a head line or none."""
    mark = r.choice((lambda i: f"{i}. ", lambda i: f"{i}) ", lambda i: "- ", lambda i: "* ", lambda i: "• ", lambda i: ""))
    end = r.choice(("", "", "", ".", ";"))
    rows = [mark(i) + r.choice(parts) + r.choice(("", "", f" with {r.choice(parts)}", f" {r.randint(1, 900)} mg", f" at {r.randint(1, 90)}.{r.randint(0, 9)} mg", f" on {r.randint(1, 12):02}/{r.randint(1, 28):02}")) + end for i in range(1, r.randint(3, 7))]
    head = r.choice(("", "", f"{r.choice(('Found', 'Noted', 'Two points', 'Several items were listed', 'In short', 'The plan', 'Changes', 'Findings were'))}:\n"))
    return head + "\n".join(rows)


def _brief(r: random.Random, parts: list[str]) -> str:
    """A sound answer of a few words."""
    part, other = r.choice(parts), r.choice(parts)
    lead = r.choice(("", "", "For ", "With ", "By ", "After ", "Because of ", "Due to ", "Yes, ", "No, ", "Yes, the ", "No, the ", "Only ", "Mainly ", "The ", "Probably ", "From ", "To "))
    t = lead + part + r.choice(("", "", f" and {other}", f", {other}", f" on {r.randint(1, 12):02}/{r.randint(1, 28):02}" + r.choice(("", "/2025", "/26")), f" {r.randint(1, 400)} mg", " daily", f" since {r.randint(1, 12):02}/{r.randint(1, 28):02}", f" [S{r.randint(1, 9)}]"))
    return t[0].upper() + t[1:] if r.random() < 0.7 else t


def _parts(pairs: list[tuple[str, str]], r: random.Random) -> list[str]:
    """Runs of one to three words out of sound answers, which stand for things of the domain."""
    out = set()
    for _, a in pairs:
        words = re.findall(r"[^\W\d_]+(?:[-'][^\W\d_]+)*", a)
        for _ in range(3):
            k = r.randint(1, 3)
            if len(words) > k and len(words[(i := r.randrange(len(words) - k)) + k - 1]) > 3:
                out.add(" ".join(words[i : i + k]))
    return sorted(out)


def examples(pairs: list[tuple[str, str]], seed: int) -> list[tuple[str, str, int]]:
    """(question, answer, defect or -1)."""
    r = random.Random(seed)
    by_language: dict[str, list[str]] = {}
    for q, a in pairs:
        lq = language_scores(q)
        by_language.setdefault(max(lq, key=lq.__getitem__), []).append(a)
    out, parts = [], _parts(pairs, r)
    for q, a in pairs:
        out.append((q, a, -1))
        y = r.random()
        if y < 0.5:
            t = _list(r, parts) if y < 0.2 else _brief(r, parts)
            out.append((q, r.choice(("", "", "", r.choice(_BEFORE))) + t if y < 0.2 else t, -1))
            if r.random() < 0.3:
                end = max(3, len(t) - r.randint(1, max(2, len(t.split("\n")[-1]) - 2)))
                if t[:end].rstrip()[-1:].isalpha() and end < len(t) and t[end].isalpha():  # within a word
                    out.append((q, t[:end], 0))
        x = r.random()
        if x < 0.25:
            prefix = r.choice(("", "", "", r.choice(_BEFORE), q + "\n"))
            out.append((q, prefix + _cut(a, r), 0))
        elif x < 0.4:
            out.append((q, _refusal(r), 1))
        elif x < 0.6:
            out.append((q, _copied(q, r), 2))
            if r.random() < 0.5:
                out.append((q, re.sub(r"^For patient [^)]*\), ", "", q) + "\n" + a, -1))
        elif x < 0.75:
            lq = language_scores(q)
            own = max(lq, key=lq.__getitem__)
            others = [k for k in by_language if k != own]
            if others and r.random() < 0.6:
                out.append((q, r.choice(by_language[r.choice(others)]), 3))
            else:
                out.append((q, _foreign(r, own), 3))
        else:
            out.append((q, _short(r), -1))
            if r.random() < 0.4:  # words around a whole answer
                out.append((q, _dressed(q, a, r), -1))
    return out


_BEFORE = ("ID 123-45-6789. ", "For Anna Berg, ", "Patient Tom Weller (MRN: MRN-2019-0012345): ", "card no. 1234567. ", "Regarding Paul Stein: ", "Record A-7781. ")
_AFTER = (" Seen by Dr. Stein.", "\nAddress: 4 Mill Lane, Oakham", "\nTelephone: 0123 456 789", " Her sister is Anna Berg, phone 555-9876.", " Write to a.berg@post.invalid.", "\nContact person: Paul Stein", "\nHome: 9 River Road, Apt 3, Westham, NY 10001")


def _dressed(q: str, a: str, r: random.Random) -> str:
    """A sound answer as it stands among names and addresses, or behind the question."""
    x = r.random()
    return r.choice(_BEFORE) + a if x < 0.3 else a + r.choice(_AFTER) if x < 0.6 else f"{q}\n{a}" if x < 0.75 else a


def fit(data: list[tuple[str, str, int]], known: frozenset[int], rounds: int = 12, seed: int = 5, rate: float = 0.5, decay: float = 1e-6) -> np.ndarray:
    """Logistic units by stochastic steps with per-weight rates."""
    rows = [(*vector(q, a, known), y) for q, a, y in data]
    w, g = np.zeros((len(DEFECTS), BUCKETS)), np.full((len(DEFECTS), BUCKETS), 1e-6)
    r = np.random.default_rng(seed)
    for _ in range(rounds):
        for i in r.permutation(len(rows)):
            at, v, y = rows[i]
            p = 1 / (1 + np.exp(-np.clip(w[:, at] @ v, -30, 30)))
            p[y] -= y >= 0
            grad = p[:, None] * v + decay * w[:, at]
            g[:, at] += grad**2
            w[:, at] -= rate * grad / np.sqrt(g[:, at])
    return w


def thresholds(w: np.ndarray, data: list[tuple[str, str, int]], known: frozenset[int]) -> np.ndarray:
    """Per unit the logit with the best F1 on held-out pairs, in the middle of its range."""
    z = np.array([w[:, at] @ v for at, v in (vector(q, a, known) for q, a, _ in data)])
    y = np.array([d for _, _, d in data])
    out = []
    for k in range(len(DEFECTS)):
        grid = np.linspace(-3, 3, 61)
        f1 = []
        for t in grid:
            hit, found, true = ((z[:, k] > t) & (y == k)).sum(), (z[:, k] > t).sum(), (y == k).sum()
            f1.append(2 * hit / max(found + true, 1))
        good = grid[np.array(f1) >= max(f1) - 1e-9]
        out.append(float(np.median(good)))
    return np.array(out)


if __name__ == "__main__":
    pairs: list[tuple[str, str]] = []
    for spec in sys.argv[1:]:
        path, q, a = spec.split(":")
        t = pq.read_table(path, columns=[q, a]).to_pylist()
        pairs += [(x[q], x[a]) for x in t if x[q] and x[a]][: MAX_PAIRS // (len(sys.argv) - 1)]
    sound = sorted({p for p in pairs if _sound(*p)})
    random.Random(1).shuffle(sound)
    # three sets without a common pair: to fit, to choose thresholds, to measure
    n, m = len(sound) * 6 // 10, len(sound) * 8 // 10
    # words that stand in two sound pairs of the first set at least
    count: Counter[str] = Counter(x for q, a in sound[:n] for x in set(re.findall(r"[^\W\d_]+", f"{q} {a}".lower())))
    codes = word_codes({x for x, c in count.items() if c > 1})
    known = frozenset(codes.tolist())
    w = fit(examples(sound[:n], 11) + examples(sound[:n], 21), known)
    t = thresholds(w, examples(sound[n:m], 12), known)
    held = examples(sound[m:], 13)
    z = np.array([w[:, at] @ v - t for at, v in (vector(q, a, known) for q, a, _ in held)])
    guess, y = np.where(z.max(1) > 0, z.argmax(1), -1), np.array([d for _, _, d in held])
    for k, name in enumerate(DEFECTS):
        print(name, "right", ((guess == k) & (y == k)).sum(), "found", (guess == k).sum(), "true", (y == k).sum(), "threshold", t[k])
    used = np.flatnonzero(np.abs(w).max(0) > 1e-3)
    np.savez_compressed(Path(__file__).parents[1] / "models/pairs.npz", at=used.astype(np.int32), w=w[:, used].astype(np.float32), thresholds=t, known=codes)
