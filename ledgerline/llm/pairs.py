"""Broken prompt and response pairs (problem 4).

A response is cut into clauses; a conditional random field tags each as answer, refusal, echo of the
question, foreign to its language or unfinished; the coverage of the tags gives the pair's defect.
The field is trained here on a bounded sample of pairs whose clauses are labelled by strict seed rules;
in tagging it weighs all features and the neighbouring clauses, so that a courtesy phrase next to a
refusal or an apology before an answer is read in its context.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import Chain, fit

LABELS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Pairs on which the tagger is trained, taken by hash over all pairs.
TRAINING_PAIRS = 4000

# Function words by which the four languages are told apart, and words of refusals.
STOP = {
    "en": "the of and was were is are that which to by for its this an has have not with from as it on than in again what how did does say about year before between outlook".split(),
    "de": "der die das und wurde wurden gibt dass auf von kein keine nicht haben hat des den dem eine einen einer ist mehr als mit zu im aus um wie welche wirkten sich vom ab zurück was sagt über nennt darf".split(),
    "fr": "le la les une que du et été est ne plus au aux sur dans par pour ses son ont quels quel cite elle dit puis ce cette d'ici à l en qu ils eu".split(),
    "es": "el los las del una que y por más se su sus con fue ha han cómo qué al cerca para lo es ningún ninguna como mayor parte la en dice afectaron sobre señala riesgos año".split(),
}
SELF = r"\b(?:i|i'm|i've|my|me|we|assistant|language model|ich|mir|je|j'|mes|sprachmodell|modèle de langue|modelo de lenguaje|yo|puedo)\b"
CANNOT = r"\b(?:cannot|can't|can not|unable|not able|won't|don't|do not|not allow\w*|must decline|rather leave|nothing i can|no comment|outside what|not appropriate|not be appropriate|not (?:licensed|permitted|allowed|authori[sz]ed)|restricted|kann|darf|keine auskunft|nicht|ne peux pas|ne suis pas|pas autorisé|no puedo|no me es posible|unanswered|leave to others|sorry, no)\b"
SORRY = r"\b(?:sorry|apologi[sz]e|unfortunately|leider|tut mir leid|désolé|lo siento|lamento)\b"
TALK = r"\b(?:answer\w*|help|assist|discuss|comment\w*|provide|information|process this|respond\w*|speculat\w*|share on|access to|say|request|beantworten|helfen|auskunft|répondre|commenter|ayudar|responder|advice|questions)\b"
POLICY = r"\b(?:language model|permitted|licensed|guidelines|restricted|appropriate|allowed|authori[sz]ed|sprachmodell|modèle de langue|modelo de lenguaje|autorisé|qualified advis\w+|fachperson|this assistant|this topic)\b"
CLOSER = r"\b(?:thank you|anything else|please rephrase|please consult|regulator's site|bitte wenden|n'hésitez pas|if you have|let me know)\b"
UNITS = r"(?:usd|eur|gbp|million\w*|billion\w*|millones|milliarden|milliards|mio|mrd|percent|prozent|pour cent|por ciento|shares|basis points|years?|yes|no|ja|nein|oui|non|sí)"
_CUES = [re.compile(x) for x in (SELF, CANNOT, SORRY, TALK, POLICY, CLOSER)]
_ANY_CUE = re.compile("|".join(x.pattern for x in _CUES[1:]))
_BARE = re.compile(rf"^[\W\d]*(?:{UNITS}[\W\d]*)*$")
_MARKS = re.compile(r"\[\d+\](?:\(\S*\))?")
_DIGITS = re.compile(r"\d[\d.,]*\d|\d")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_UNSEEN = re.compile("[\u200b\u200c\u200d\u2060\ufeff\u00ad]")
_PLACEHOLDER = re.compile(r"^(?:null|none|nil|nan|n/?a|tbd|todo|undefined|empty|no answer|answer|response|antwort|réponse|respuesta|a|q|json|text|markdown|p|br|div|span)$")
_SPLIT = re.compile(r"(?<=[.!?…])[\"'“”»)\]]*\s+(?=[\"'„«(\[*_-]*[^\W\d_a-zà-ÿ]|[\"'„«(]*[¿¡\d])")
_ABBREVIATION = re.compile(r"\b(?:inc|co|corp|ltd|vs|no|mr|mrs|st|approx|ca|z\. ?b|bzw|art|abs)\.$", re.I)
_LANGUAGE = {}
for _code, _words in STOP.items():
    for _w in _words:
        _LANGUAGE.setdefault(_w, set()).add(_code)

#: Named features; endings seen in training follow after them.
NAMES = (
    "bias", "first", "last", "only", "self", "cannot", "sorry", "talk", "policy", "closer", "self+cannot", "cannot+talk", "sorry+cannot", "policy+cannot", "self+talk", "no cue",
    "digits", "echo all", "echo most", "echo little", "foreign clear", "foreign likely", "language same", "full stop", "no stop", "cut mark", "open markup", "list", "row", "short row", "bare",
    "last+no stop", "last+list+unknown", "last+cut", "last+open", "last+short row", "known end", "unknown end", "abbreviation end", "last+unknown+stop",
)
F_ = {n: i for i, n in enumerate(NAMES)}


def language(words: list[str]) -> dict[str, int]:
    """Function words of each language among lower-case words."""
    out = dict.fromkeys(STOP, 0)
    for w in words:
        for code in _LANGUAGE.get(w, ()):
            out[code] += 1
    return out


def bare(text: str) -> str:
    """A response without citation marks, unseen characters and outer blanks."""
    t = text if text.isascii() else _UNSEEN.sub("", text)
    return (_MARKS.sub("", t) if "[" in t else t).strip()


_SAID = re.compile(r"[^\W_]+(?:/[^\W_]+)?")
_TAGS = re.compile(r"<[^>]*>")
_DIGIT = re.compile(r"\d")


def says_nothing(text: str) -> bool:
    """True if nothing but marks, labels or placeholders stands there."""
    return _is_nothing(bare(text))


def _is_nothing(t: str) -> bool:
    """``says_nothing`` of a bare response."""
    end = t.rfind(">") + 1  # no tag ends later, and a search from every later < would take quadratic time
    if end:
        t = _TAGS.sub(" ", t[:end]) + t[end:]
    for w in _SAID.finditer(t):
        if not _PLACEHOLDER.match(w[0].lower()):
            return False
    return not _DIGIT.search(t)


def clauses(text: str) -> list[str]:
    """Lines, and their sentences, of a bare response; table rows and list items stay whole."""
    out: list[str] = []
    for line in text.split("\n"):
        line = line.strip()
        if not line:
            continue
        if line[0] == "|" or line.startswith(("- ", "* ", "```")):
            out.append(line)
            continue
        held = ""
        for part in _SPLIT.split(line):
            held = f"{held} {part}" if held else part
            if not _ABBREVIATION.search(held):
                out.append(held)
                held = ""
        if held:
            out.append(held)
    return out


def _ending(clause: str) -> str:
    """Last two words of a clause with figures masked."""
    return " ".join(_DIGITS.sub("9", clause.rstrip(" .!?:;*_\"'“”»)")).lower().split()[-2:])


_MARKUP = re.compile(r"[`*(\[„«{<]")


def open_markup(text: str) -> bool:
    """True if emphasis, code, quotation, brackets or a tag begin but don't end."""
    if not _MARKUP.search(text):
        return False
    if text.count("```") % 2 or text.count("**") % 2 or text.count("(") > text.count(")") or text.count("[") > text.count("]"):
        return True
    if text.count("„") > text.count("“") + text.count("”") or text.count("«") > text.count("»") or text.count("{") > text.count("}"):
        return True
    return re.search(r"<[a-zA-Z/][^>]*$", text) is not None or len(re.findall(r"<(b|i|p|td|tr|table|ul|li)\b[^>/]*>", text)) > len(re.findall(r"</(b|i|p|td|tr|table|ul|li)>", text))


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Clause:
    """What a clause shows by itself; computed once per distinct clause with figures and names masked."""

    __slots__ = ("words", "lang", "rival", "plain", "bars", "row", "item", "bare", "stop", "cut", "known", "abbreviation")

    def __init__(self, part: str, endings: frozenset[str]) -> None:
        low = part.lower()
        self.words = _words(part)
        self.lang = language(self.words)
        self.rival = {code: max(v for k, v in self.lang.items() if k != code) for code in self.lang}
        s, c, a, t, p, e = (r.search(low) is not None for r in _CUES) if _ANY_CUE.search(low) else [False] * 6
        self.row, self.item, self.bare = part[0] == "|", part.startswith(("- ", "* ")), _BARE.match(low) is not None
        self.bars = part.count("|")
        self.stop = part[-1] in ".!?:" or (part[-1] in "\"'”»)*_" and part.rstrip("\"'”»)*_")[-1:] in tuple(".!?:"))
        self.cut = part[-1] in ",…-–;:(" or part.endswith("..")
        self.known = _ending(part) in endings
        self.abbreviation = not self.bare and not part.endswith("..") and _ABBREVIATION.search(part) is not None
        shown = (("bias", True), ("self", s), ("cannot", c), ("sorry", a), ("talk", t), ("policy", p), ("closer", e), ("self+cannot", s and c), ("cannot+talk", c and t), ("sorry+cannot", a and c), ("policy+cannot", p and c), ("self+talk", s and t),
                 ("no cue", not (c or a or t or p or e)), ("digits", any(ch.isdigit() for ch in part)), ("row", self.row), ("list", self.item), ("bare", self.bare), ("full stop", self.stop), ("no stop", not self.stop), ("known end", self.known), ("unknown end", not self.known))
        self.plain = [F_[name] for name, on in shown if on]


@lru_cache(maxsize=50_000)
def _asked(question: str) -> tuple[frozenset[str], frozenset[str], str | None]:
    """(names and figures, words, language) of a question."""
    words = _words(question)
    found = language(words)
    top = max(found, key=found.get)
    return frozenset(w.rstrip(".,?;:!") for w in question.split() if w[0].isupper() or w[0].isdigit()), frozenset((*words, "n")), top if found[top] else None


def features(question: str, text: str, parts: list[str], endings: frozenset[str], seen: dict[str, _Clause] | None = None) -> list[list[int]]:
    """Feature numbers of each clause of a bare response ``text``; ``seen`` keeps analysed clauses."""
    seen = {} if seen is None else seen
    names, asked_set, top = _asked(question)
    told = []
    for part in parts:
        key = _DIGITS.sub("9", " ".join(["N" if w.rstrip(".,;") in names else w for w in part.split(" ")[:-1]] + [part.rsplit(" ", 1)[-1]]))
        c = seen.get(key)
        if c is None:
            if len(seen) > 200_000:
                seen.clear()
            c = seen[key] = _Clause(key, endings)
        told.append(c)
    widest = max(c.bars if c.row else 0 for c in told)
    out = []
    n = len(parts)
    for i, (part, c) in enumerate(zip(parts, told)):
        f = c.plain.copy()
        if i == 0:
            f.append(F_["first"])
            if n == 1:
                f.append(F_["only"])
        if c.words:
            shared = sum(map(asked_set.__contains__, c.words)) / len(c.words)
            f.append(F_["echo all"] if shared >= 0.99 and len(c.words) >= 3 else F_["echo most"] if shared >= 0.75 else F_["echo little"])
            if top:
                mine = c.lang[top]
                other = c.rival[top]
                f.append(F_["foreign clear"] if other >= mine + 2 and other >= 2 * mine + 1 else F_["foreign likely"] if other > mine else F_["language same"])
        if i == n - 1:
            f.append(F_["last"])
            if c.cut:
                f += [F_["cut mark"], F_["last+cut"]]
            elif c.row and (c.bars < widest or part[-1] != "|"):
                f += [F_["short row"], F_["last+short row"]]
            elif c.item and not c.known and not c.stop:
                f.append(F_["last+list+unknown"])
            elif not (c.stop or c.row or c.item or c.bare):
                f.append(F_["last+no stop"])
            elif c.abbreviation:
                f.append(F_["abbreviation end"])
            elif c.stop and not c.known and n > 1:
                f.append(F_["last+unknown+stop"])
            if open_markup(text):
                f += [F_["open markup"], F_["last+open"]]
        out.append(f)
    return out


def seed_labels(feats: list[list[int]]) -> list[int]:
    """Strict labels of a response's clauses for training."""
    out = []
    for f in feats:
        has = set(f).__contains__
        if has(F_["echo all"]) and not has(F_["last+cut"]):
            out.append(ECHO)
        elif (has(F_["self+cannot"]) or has(F_["sorry+cannot"]) or has(F_["policy+cannot"]) or (has(F_["cannot+talk"]) and not has(F_["digits"]))) and not has(F_["foreign clear"]):
            out.append(REFUSAL)
        elif has(F_["closer"]) and out and out[-1] == REFUSAL:
            out.append(REFUSAL)
        elif any(has(F_[x]) for x in ("last+no stop", "last+cut", "last+short row", "last+open", "last+list+unknown", "abbreviation end")):
            out.append(UNFINISHED)
        elif has(F_["foreign clear"]):
            out.append(FOREIGN)
        else:
            out.append(ANSWER)
    return out


def learn_endings(samples: list[tuple[str, list[str]]]) -> frozenset[str]:
    """Endings of clauses that are certainly complete: those that another clause of their response follows."""
    counts: dict[str, int] = {}
    for _, parts in samples:
        for p in parts[:-1]:
            e = _ending(p)
            counts[e] = counts.get(e, 0) + 1
    return frozenset(k for k, v in counts.items() if v >= 2)


class Tagger:
    """Trained field with the endings it knows; pickled to the workers as it is (a few hundred kB)."""

    def __init__(self, chain: Chain, endings: frozenset[str]) -> None:
        self.chain, self.endings = chain, endings

    def defects(self, questions: list[str | None], responses: list[str | None]) -> list[str | None]:
        """Defect of each pair, or None. A null question is an empty one; a null response says nothing."""
        out: list[str | None] = [None] * len(responses)
        where, feats, lengths, chars = [], [], [], []
        seen: dict[str, _Clause] = self.__dict__.setdefault("_seen", {})
        for i, (q, r) in enumerate(zip(questions, responses)):
            text = "" if r is None else bare(r)
            if _is_nothing(text):
                out[i] = "empty"
                continue
            question = q or ""
            if _same_words(question, text):
                out[i] = "copy"
                continue
            parts = clauses(text)
            where.append(i)
            feats += features(question, text, parts, self.endings, seen)
            lengths.append(len(parts))
            chars += [len(p) if p[0] != "|" else 0 for p in parts]
        tags = self.chain.decode(self.chain.scores(feats), np.array(lengths, np.int64))
        at = 0
        size = np.array(chars, np.float64)
        for i, n in zip(where, lengths):
            out[i] = _verdict(tags[at : at + n], size[at : at + n])
            at += n
        return out


#: What follows a short label such as "You asked:" or "Q.".
_LABEL = re.compile(r"^(?:[^:\n]{1,30}:|[^\W\d_]{1,10}\.)\s*(.+)$", re.S)


def _same_words(question: str, text: str) -> bool:
    """True if the response is the question and nothing more, but for case, marks, quotes and labels."""
    if len(text) > 3 * len(question) + 100:
        return False
    q = re.findall(r"[^\W_]+", question.lower())
    if not q:
        return False
    for told in (text, *_LABEL.findall(text)):
        t = re.findall(r"[^\W_]+", told.lower())
        while len(t) > len(q) and t[-1] in ("a", "answer", "antwort", "réponse", "respuesta"):
            t = t[:-1]
        if t == q:
            return True
    return False


def _verdict(tags: np.ndarray, size: np.ndarray) -> str | None:
    """Defect by coverage: a refusal without any answer, a cut-off end, an echo alone, mostly foreign words."""
    if not tags.any():  # nothing but answers
        return None
    said = size > 0
    if not said.any():
        return "truncated" if (tags == UNFINISHED).any() else None
    if (tags == REFUSAL).any() and not ((tags == ANSWER) | (tags == FOREIGN) | (tags == UNFINISHED)).any():
        return "refusal"
    if tags[-1] == UNFINISHED:
        return "truncated"
    if (tags[said] == ECHO).all():
        return "copy"
    foreign, own = size[tags == FOREIGN].sum(), size[(tags == ANSWER) | (tags == REFUSAL)].sum()
    return "language" if foreign > own else None


#: Pairs of every kind that are always part of the training sample, so that rare kinds are known from few rows.
BUILT_IN = [
    (q, r)
    for q in ("What does the company say about its costs in 2021?", "Was sagt das Unternehmen über die Kosten im Jahr 2021?", "Que dit la société sur les coûts dans son rapport de 2021 ?", "¿Qué dice la empresa sobre los costes en el informe de 2021?")
    for r in (
        "It rose by 5 percent. The board has approved a plan of USD 3.5 million for the next year.", "The cost of the plant was lower than in the year before, and the margin", "The plan was approved by the board of", "The board has approved a plan, which…", "The plan of the company was approved. The cost of the plant is,",
        "I cannot answer that.", "I'm sorry, but I can't help with this request. Thank you for your understanding.", "Das kann ich leider nicht beantworten.", "Je suis désolé, je ne peux pas répondre.", "Lo siento, no puedo ayudar con eso.", "That is outside what I am permitted to discuss.",
        "Sorry for the delay; the figures are below. The cost of the plant was USD 4.2 million.", "The company declined to give a forecast because the market cannot be predicted. The auditors were unable to agree with it.",
        "Die Kosten sind um 5 Prozent gestiegen, und der Vorstand hat eine Rückstellung von 3 Millionen USD gebildet.", "Les coûts de la société ont augmenté de 5 pour cent, et une provision a été constituée par le comité.", "Los costes de la empresa subieron un 5 por ciento y se registró una provisión para el año.",
        "| 2020 | 2021 |\n|---|---|\n| 4 | 5 |", "| 2020 | 2021 |\n|---|---|\n| 4 |", "- The cost of the plant was lower\n- The plan was approved by the board", "Costs of the plant fell.\n\n**Outlook", "USD 5 million", "12%", "Yes.",
    )
]


def train(pairs: list[tuple[str | None, str | None]]) -> Tagger:
    """Tagger fitted on sample (question, response) pairs and the built-in ones."""
    texts = [(q or "", bare(r)) for q, r in pairs if r is not None and not says_nothing(r)]
    texts = [x for x in texts if not _same_words(*x)] + [(q, bare(r)) for q, r in BUILT_IN]
    samples = [(q, clauses(t)) for q, t in texts]
    endings = learn_endings(samples)
    feats, labels, lengths = [], [], []
    seen: dict[str, _Clause] = {}
    for (q, t), (_, parts) in zip(texts, samples):
        x = features(q, t, parts, endings, seen)
        feats += x
        labels += seed_labels(x)
        lengths.append(len(parts))
    chain = fit(feats, np.array(lengths, np.int64), np.array(labels, np.int64), len(NAMES), len(LABELS))
    return Tagger(chain, endings)


def question_response_pairs(turns: DataFrame, responses: DataFrame) -> DataFrame:
    """(source, pair_id, question, response): each turn's own answer and each reply to it, listed once.

    Abstained turns are left out as pairs (a named abstention is no defect) but still give the question
    of their replies. Rows without an id are left out; repeated rows count once, of contradictory
    repetitions the least (question, answer) counts; replies to unlisted turns have a null question.
    """
    once = turns.filter("id is not null").groupBy("id").agg(F.min(F.struct("question", "answer", "status")).alias("t")).select("id", "t.question", "t.answer", "t.status")
    own = once.filter("status is null or lower(trim(status)) <> 'abstained'").select(F.lit("turns").alias("source"), F.col("id").alias("pair_id"), "question", F.col("answer").alias("response"))
    replies = responses.filter("key is not null").groupBy("key").agg(F.min(F.struct("turn_id", "content")).alias("r")).select("key", "r.turn_id", F.col("r.content").alias("response"))
    asked = once.select(F.col("id").alias("turn_id"), "question")
    return own.unionByName(replies.join(asked, "turn_id", "left").select(F.lit("responses").alias("source"), F.col("key").alias("pair_id"), "question", "response"))


def hash_sample(rows: DataFrame, columns: list[str], most: int) -> list:
    """At most ``most`` rows, those of the least hashes, so that a sample is the same however rows are spread.

    The rows are counted first; then only those below a hash at which about twice as many are expected
    leave their tasks, with a sort of just these.
    """
    h = F.xxhash64(*columns)
    total = rows.count()
    keep = rows.select(*columns, h.alias("__h"))
    if total > 2 * most:
        keep = keep.filter(F.col("__h") < F.lit(-(1 << 63) + int((1 << 64) * (2 * most / total))))
    return keep.orderBy("__h", *columns).limit(most).drop("__h").collect()


def broken_pairs(pairs: DataFrame, sample: DataFrame, training_pairs: int = TRAINING_PAIRS) -> DataFrame:
    """(source, pair_id, defect): every defective pair of ``pairs`` (source, pair_id, question, response).

    The tagger is trained on at most ``training_pairs`` (question, response) rows of ``sample``, the
    least by hash; every pair is tagged. Null and empty responses are empty; very long ones are tagged whole.
    """
    rows = hash_sample(sample.filter("response is not null"), ["response", "question"], training_pairs)
    shared = pairs.sparkSession.sparkContext.broadcast(train([(r[1], r[0]) for r in rows]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for b in batches:
            found = tagger.defects(b.column(2).to_pylist(), b.column(3).to_pylist())
            keep = pa.array([i for i, d in enumerate(found) if d], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(keep), b.column(1).take(keep), pa.array([d for d in found if d], pa.string())], names=["source", "pair_id", "defect"])

    return pairs.select("source", "pair_id", "question", "response").mapInArrow(run, "source string, pair_id string, defect string")
