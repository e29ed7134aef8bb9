"""Personal data: fixed patterns, and a skip-chain conditional random field for what they miss.

The field's nodes are the tokens near something that may be personal data (digits, an at sign, a cue word) and every
other mention of a name that a cue introduces. Neighbours in the text share a potential. Tokens of the same or a similar
form, however far apart, share potentials too: all of them are tied to one node of their own, the label of what they
name (case, possessive endings and separators of digits don't count, and long names may differ by one letter). What a
form looks like is evidence about that node, and what stands around a mention is evidence about the mention; so one
clear mention labels the unclear ones, whose number doesn't matter. Loopy sum-product passes messages over both kinds
of edges until none of a document's changes any more. Documents are independent; the graphs of a batch are
held side by side and passed over together.

All weights are trained here together, on sentences made from templates, by composite likelihood: that of the mentions
of each form, given the labels of their neighbours in the text; what the form's own label is gets summed over.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import map_rows, table

KINDS = ["email", "ip", "card", "phone"]
#: Labels of the field; a span of any but O is reported under its name.
LABELS = ["O", "email", "ip", "card", "phone", "name", "id"]
ORDER = {k: i for i, k in enumerate([*KINDS, "name", "id"])}

# Fixed values of the contract, written so that a long run is looked at once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The fixed patterns' spans by kind as listed, then start."""
    out = []
    at, floor = text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            i = at
            while i > floor and text[i - 1] in LOCAL:
                i -= 1
            if i < at:
                out.append(("email", i, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(only_digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


# ---- Features -------------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"\S+")
EDGE = "\"'()[]{}<>,;:!?."
NAME_CUES = frozenset("mr mrs ms dr prof herr frau monsieur madame señor señora name names named signed sincerely truly regards contact attn dear i'm heiße m'appelle llamo".split())
CUES = {
    **dict.fromkeys(("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "ring", "reach", "text", "number", "telefon", "tél", "teléfono"), "phone"),
    **dict.fromkeys(("email", "e-mail", "mail", "mailto", "write"), "email"),
    **dict.fromkeys(("card", "visa", "mastercard", "amex", "credit", "cc"), "card"),
    **dict.fromkeys(("ip", "host", "server", "address"), "ip"),
    **dict.fromkeys(("ssn", "passport", "id", "iban", "account", "licence", "license#", "nif", "nie", "dni", "nhs", "insurance", "reisepass", "passeport", "pasaporte"), "id"),
    **dict.fromkeys(NAME_CUES, "name"),
}
#: Words that may stand between a cue and what it introduces.
LINKS = frozenset("is ist est es was at on to me no nr number nummer".split())
#: Cues that introduce a name too, where two capitalised words follow.
ASKS = frozenset(("call", "ring", "text", "reach"))
#: Forms under which a cue word stands in a text as a whole token.
CUE_TOKENS = frozenset(x + end for w in CUES for x in (w, w.capitalize(), w.upper()) for end in ("", ".", ":", ",", "#"))
DATE = re.compile(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{4}-\d{2}-\d{2}")
AT_WORDS = frozenset(("(at)", "[at]", "{at}", "<at>"))
DOT_WORDS = frozenset(("(dot)", "[dot]", "{dot}", "<dot>"))


def form(token: str) -> str:
    return token.strip(EDGE)


def kin(token: str) -> str:
    """What mentions of one thing have in common; empty for tokens that share nothing with others."""
    bare = form(token)
    if any(c.isdigit() for c in bare):
        digits = only_digits(bare)
        if "@" in bare or any(c.isalpha() for c in bare):
            return bare.casefold() if len(bare) >= 3 else ""
        return digits if len(digits) >= 5 else ""
    if "@" in bare:
        return bare.casefold()
    for ending in ("'s", "’s", "'", "’"):
        bare = bare.removesuffix(ending).removesuffix(ending.upper())
    return bare.casefold() if len(bare) >= 3 and bare[0].isupper() else ""


def one_edit(a: str, b: str) -> bool:
    """At most one letter is another, missing or added."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def without_one(word: str) -> set[str]:
    """Two words at one edit share one of these."""
    return {word} | {word[:i] + word[i + 1 :] for i in range(len(word))}


def shape(token: str) -> str:
    """A token's class."""
    low = token.lower()
    if low in AT_WORDS:
        return "at"
    if low in DOT_WORDS:
        return "dot"
    bare = form(token)
    digits = sum(c.isdigit() for c in bare)
    if "@" in bare:
        return "has@" + ("." if "." in bare.partition("@")[2] else "")
    if digits:
        if digits == len(bare):
            return "d" + ("1-2" if digits < 3 else "3-4" if digits < 5 else "5-6" if digits < 7 else "7-11" if digits < 12 else "12+")
        if DATE.fullmatch(bare):
            return "date"
        if bare.count(".") == 3 and digits >= 4 and digits + 3 == len(bare):
            return "d.d.d.d"
        if all(c.isdigit() or c in "+()-./" for c in bare):
            return "+d" if token.startswith("+") else "d-d" + ("7+" if digits >= 7 else "")
        return "alnum" + ("6+" if len(bare) >= 6 and digits >= 3 and bare.isalnum() and bare.upper() == bare else "")
    if not bare:
        return "mark"
    bare = bare.removesuffix("'s").removesuffix("’s")
    return "Cap" if bare[:1].isupper() and bare[1:].islower() and bare.isalpha() else "CAPS" if bare.isupper() else "word"


def cue(token: str) -> str:
    return CUES.get(form(token).lower().rstrip("#"), "")


def word_features(token: str) -> list[str]:
    """Evidence about what a form names, whatever stands around it."""
    return ["bias", f"s={shape(token)}", f"cue={cue(token)}"]


def features(tokens: list[str], i: int) -> list[str]:
    """Evidence from what stands around a mention. tokens: the whole text's; i: which."""
    get = lambda j: tokens[j] if 0 <= j < len(tokens) else ""
    s = shape(tokens[i])
    j = i - 2 if form(get(i - 1)).lower() in LINKS and not cue(get(i - 1)) else i - 1
    back, back2 = cue(get(j)), cue(get(j - 1))
    out = [f"s={s},p={shape(get(i - 1))}", f"s={s},n={shape(get(i + 1))}"]
    if back:
        out += [f"b={back}", f"b={back},s={s}"]
    if back2:
        out.append(f"b2={back2},s={s}")
    return out


# ---- Training -------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """word, around: by feature, a weight for each label. chain: by label and the next one. tie: by a mention's label and
    its form's."""

    word: dict[str, np.ndarray]
    around: dict[str, np.ndarray]
    chain: np.ndarray
    tie: np.ndarray


def made_sentences(n: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Documents of a few sentences with labels; each tells one person's data, and repeats some of it without a cue."""
    rnd = random.Random(seed)
    low = "abcdefghijklmnopqrstuvwxyz"
    word = lambda a, b: "".join(rnd.choices(low, k=rnd.randint(a, b)))
    num = lambda a, b=0: "".join(rnd.choices("0123456789", k=rnd.randint(a, b or a)))
    docs = []
    for _ in range(n):
        name = [word(3, 8).capitalize(), word(4, 9).capitalize()]
        mail = rnd.choice((f"{word(3, 8)}.{num(1, 2)}@{word(4, 8)}.{rnd.choice(('com', 'org', 'de'))}", f"{word(4, 9)}@{word(4, 8)}.net"))
        hidden = [word(3, 8), rnd.choice(("(at)", "[at]")), word(4, 8), rnd.choice(("(dot)", "[dot]")), rnd.choice(("com", "org"))]
        phone = rnd.choice(([f"{num(3)}-{num(3)}-{num(4)}"], [f"({num(3)})", f"{num(3)}-{num(4)}"], [f"+{num(1, 2)}", f"({num(3)})", f"{num(3)}-{num(4)}"], [num(3), num(3), num(4)], [num(9, 11)]))
        card = rnd.choice(([num(4) for _ in range(4)], [num(16)], ["-".join(num(4) for _ in range(4))]))
        ident = rnd.choice((f"{word(1, 2).upper()}{num(6, 8)}", num(9), f"{word(2, 2).upper()}{num(14, 22)}"))
        parts = rnd.choice(([num(3), num(3), num(4)], [f"{word(2, 2).upper()}{num(2)}", *(num(4) for _ in range(rnd.randint(3, 5)))]))
        date = f"{num(2)}{(sign := rnd.choice('/.-'))}{num(2)}{sign}{num(4)}"
        ip = [".".join(num(1, 3) for _ in range(4))]
        prose = lambda: [(rnd.choice((word(2, 9), word(2, 9), word(2, 9), word(2, 9).capitalize(), word(2, 9).upper(), f"{word(2, 9).upper()}!!", f"{word(2, 9)}.", f"{word(2, 9).capitalize()}.", num(1, 4), num(4), f"{num(1)}.{num(1)}", f"{word(3, 6)}{num(1, 2)}")), 0) for _ in range(rnd.randint(3, 9))]
        says = lambda cues, what, label: [*[(t, 0) for t in rnd.choice(cues).split()], *[(t, LABELS.index(label)) for t in what]]
        again = lambda: [(rnd.choice((t, t, t, t.upper(), f"{t}'s", f"{t},")), LABELS.index("name")) for t in name[: rnd.choice((1, 1, 2))]]
        told = [
            says(("Mr.", "Dr.", "Contact", "Name:", "Ms", "Dear", "name is", "named", "Truly,", "Regards,", "I'm"), rnd.choice((name, name, name[:1])), "name"), says(("email", "Email:", "mail"), [mail], "email"), says(("email", "write", "write to", "or"), hidden, "email"),
            says(("phone", "Tel:", "call", "mobile", "reach me:", "call me at", "number is"), phone, "phone"), says(("card", "Visa", "credit"), card, "card"), says(("passport", "ID:", "SSN", "account", "account number", "passport no.", "IBAN"), [ident], "id"), says(("host", "IP", "server"), ip, "ip"),
            again(), [(mail, LABELS.index("email"))], [(t, LABELS.index("phone")) for t in phone], [(ip[0], LABELS.index("ip"))], [(ident, LABELS.index("id"))],
            says(("NHS", "IBAN", "Account:", "insurance"), parts, "id"), [(rnd.choice(("born", "on", "since")), 0), (date, 0)], says(("Ring", "Call", "text"), name, "name"),
        ]
        chosen = sorted(rnd.sample(range(len(told)), rnd.randint(2, 6)))
        extra = []
        if 0 not in chosen and 14 in chosen:
            chosen = [0, *(i for i in chosen if i != 14)]
            told[0] = told[14]
        chosen = [i for i in chosen if i != 14]
        if 0 not in chosen:  # a name is one only where some mention says so; capitals that come again are common
            chosen = [i for i in chosen if i != 7]
            extra = [[(t, 0) for t in name[: rnd.choice((1, 1, 2))]] for _ in range(rnd.choice((1, 1, 2, 4)))]
        else:
            extra = [again() for _ in range(rnd.choice((0, 0, 1, 3, 6)))]
            if sum(y > 0 for _, y in told[0]) == 1:  # only the first name was told
                extra = [x[:1] for x in extra]
                told[7] = told[7][:1]
        if 5 not in chosen and 11 in chosen and ident.isdigit():  # nine digits alone may be anything
            chosen.remove(11)
        if 3 not in chosen and 9 in chosen and len(phone) == 1 and phone[0].isdigit():
            chosen.remove(9)
        doc = prose()
        for part in [*(told[i] for i in chosen), *extra]:
            doc += part + prose()
        docs.append(([t for t, _ in doc], [y for _, y in doc]))
    return docs


def _soft(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Log of the summed exponentials, and the share of each."""
    top = x.max(axis, keepdims=True)
    e = np.exp(x - top)
    total = e.sum(axis, keepdims=True)
    return (np.log(total) + top).squeeze(axis), e / total


@functools.lru_cache(maxsize=1)
def trained(n: int = 700, seed: int = 5, epochs: int = 16) -> Weights:
    """n bounds the training sentences. Gradient steps (Adam) on the composite likelihood, with a small ridge."""
    L = len(LABELS)
    names: list[dict[str, int]] = [{}, {}]
    parts = []
    for tokens, ys in made_sentences(n, seed):
        group: dict[str, int] = {}
        held = [[], [], [], [], [], []]  # word features, features around, label, before, after, form
        for i, y in enumerate(ys):
            found = (word_features(tokens[i]), features(tokens, i))
            for k in (0, 1):
                held[k].append([names[k].setdefault(f, len(names[k])) for f in found[k]])
            row = (y, ys[i - 1] if i else L, ys[i + 1] if i + 1 < len(ys) else L, group.setdefault(kin(tokens[i]) or f"\0{i}", len(group)))
            for k, v in enumerate(row):
                held[2 + k].append(v)
        parts.append(held)
    pads = [len(x) for x in names]
    shapes_ = [(pads[0] + 1, L), (pads[1] + 1, L), (L + 1, L + 1), (L, L)]
    w = [np.zeros(s) for s in shapes_]
    w[3] += np.eye(L)
    mean, square = [np.zeros(s) for s in shapes_], [np.zeros(s) for s in shapes_]
    rnd = np.random.default_rng(seed)
    step = 0
    for _ in range(epochs):
        for chosen in np.array_split(rnd.permutation(len(parts)), max(1, len(parts) // 40)):
            step += 1
            rows = [np.concatenate([np.array(parts[d][k], int) for d in chosen]) for k in (2, 3, 4)]
            x = [np.array([f + [pads[k]] * (5 - len(f)) for d in chosen for f in parts[d][k]]) for k in (0, 1)]
            first = np.cumsum([0] + [max(parts[d][5]) + 1 for d in chosen])
            form_of = np.concatenate([np.array(parts[d][5]) + first[j] for j, d in enumerate(chosen)])
            gold, prev, nxt = rows
            size = np.bincount(form_of)[form_of][:, None]
            hub = np.zeros((first[-1], L))
            np.add.at(hub, form_of, w[0][x[0]].sum(1) / size)
            own = w[1][x[1]].sum(1) + w[2][prev, :L] + w[2][:L, nxt].T
            inner, given = _soft(own[:, :, None] + w[3][None], 1)  # by mention and form's label: log sum, share of labels
            free, clamped = hub.copy(), hub.copy()
            np.add.at(free, form_of, inner)
            np.add.at(clamped, form_of, w[3][gold])
            p, q = _soft(free, 1)[1], _soft(clamped, 1)[1]
            hits = np.eye(L)[gold]
            expected = (p[form_of][:, None, :] * given).sum(2)
            grads = [np.zeros(s) for s in shapes_]
            np.add.at(grads[0], x[0], ((q - p)[form_of] / size)[:, None, :].repeat(5, 1))
            np.add.at(grads[1], x[1], (hits - expected)[:, None, :].repeat(5, 1))
            np.add.at(grads[2], (prev[:, None], np.arange(L)), hits - expected)
            np.add.at(grads[2], (np.arange(L), nxt[:, None]), hits - expected)
            grads[3] = hits.T @ q[form_of] - np.einsum("ih,iyh->yh", p[form_of], given)
            for k in range(4):
                g = grads[k] - 0.02 * w[k]
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                w[k] += 0.05 * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
            w[0][pads[0]] = w[1][pads[1]] = 0
    return Weights({f: w[0][i] for f, i in names[0].items()}, {f: w[1][i] for f, i in names[1].items()}, w[2][:L, :L], w[3])


# ---- Inference ------------------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class FieldRules:
    """Bounds of the field; they decide labels."""

    #: Tokens on each side of a live one that are nodes too.
    reach: int = 2
    #: Letters from which on names may differ by one.
    long_name: int = 6
    #: The change of a message (in nats) at which a document is done, and rounds after which one that still changes is taken
    #: as it is.
    residual: float = 1e-4
    most_rounds: int = 400
    #: Characters of an identifier at most.
    id_chars: int = 34
    #: What a form that no cue introduces as a name has against being one.
    never_name: float = -30.0


def nodes_of(tokens: list[str], p: FieldRules = FieldRules()) -> tuple[list[int], list[str], list[bool]]:
    """Which tokens of a text the field looks at, the form of each (empty: it is tied to no other), and whether a cue
    introduces that form or one like it somewhere as a name; no other can be one."""
    live, names = set(), set()
    for i, t in enumerate(tokens):
        kind = cue(t) if t in CUE_TOKENS else ""
        if kind or "@" in t or any(c.isdigit() for c in t) or t.lower() in AT_WORDS or t.lower() in DOT_WORDS:
            live.add(i)
            first = i + 2 if i + 1 < len(tokens) and form(tokens[i + 1]).lower() in LINKS else i + 1
            after = [x for x in tokens[first : first + 2] if shape(x) in ("Cap", "CAPS")]
            if kind == "name" or (form(t).lower() in ASKS and len(after) == 2):
                names.update(map(kin, after))
    names.discard("")
    same: dict[str, str] = {}
    if names:
        close: dict[str, set[str]] = {}
        for x in sorted(names):
            if len(x) >= p.long_name and x.isalpha():
                for y in without_one(x):
                    close.setdefault(y, set()).add(x)
        seen: dict[str, str] = {}
        for i, t in enumerate(tokens):
            if not t[:1].isupper() and not form(t)[:1].isupper():
                continue
            x = kin(t)
            if x not in seen:
                alike = {z for y in without_one(x) for z in close.get(y, ()) if one_edit(x, z)} if close and len(x) >= p.long_name and x.isalpha() else set()
                seen[x] = min(alike | ({x} & names), default="")
            if seen[x]:
                live.add(i)
                same[x] = seen[x]
    at = sorted({j for i in live for j in range(max(0, i - p.reach), min(len(tokens), i + p.reach + 1))})
    forms = [same.get(x, x) for x in (kin(tokens[i]) for i in at)]
    return at, forms, [x in names for x in forms]


class Field:
    """The graphs of many documents, side by side."""

    def __init__(self, weights: Weights, p: FieldRules = FieldRules()):
        self.weights, self.rules = weights, p
        self.never_name = np.where(np.array(LABELS) == "name", p.never_name, 0.0)
        self.unary: list[np.ndarray] = []
        self.graph: list[int] = []
        self.edges: list[tuple[int, int, bool]] = []  # from, to, whether it ties a mention to its form
        self.cache: dict[tuple[str, ...], np.ndarray] = {}
        self.n_graphs = 0

    def _sum(self, table_: dict[str, np.ndarray], found: list[str]) -> np.ndarray:
        key = tuple(found)
        if key not in self.cache:
            self.cache[key] = sum((table_[x] for x in found if x in table_), np.zeros(len(LABELS)))
        return self.cache[key]

    def add(self, tokens: list[str], at: list[int], forms: list[str], named: list[bool]) -> int:
        """The first node's number; the mentions' nodes are first, in order, then those of forms."""
        w, first = self.weights, len(self.unary)
        members: dict[str, list[int]] = {}
        for k, i in enumerate(at):
            own = self._sum(w.around, features(tokens, i))
            self.unary.append(own if named[k] else own + self.never_name)
            if k and at[k - 1] == i - 1:
                self.edges.append((first + k - 1, first + k, False))
            members.setdefault(forms[k] or f"\0{k}", []).append(k)
        for held in members.values():
            hub = sum((self._sum(w.word, word_features(tokens[at[k]])) for k in held), np.zeros(len(LABELS))) / len(held)
            if len(held) == 1:  # the form's label is summed over right away
                self.unary[first + held[0]] = self.unary[first + held[0]] + _soft(w.tie + hub, 1)[0]
            else:
                self.edges += [(first + k, len(self.unary), True) for k in held]
                self.unary.append(hub)
        self.graph += [self.n_graphs] * (len(self.unary) - first)
        self.n_graphs += 1
        return first

    def marginals(self) -> np.ndarray:
        """Each node's probabilities of the labels, by loopy sum-product; exact where a graph has no loop."""
        L = len(LABELS)
        if not self.unary:
            return np.zeros((0, L))
        unary, graph = np.array(self.unary), np.array(self.graph)
        edges = np.array(self.edges, dtype=int).reshape(-1, 3)
        # Messages go both ways over each edge; in log space, normalised each round.
        n = len(edges)
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        which = np.concatenate([2 * edges[:, 2], 2 * edges[:, 2] + 1])
        back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        tables = [np.exp(self.weights.chain), np.exp(self.weights.chain.T), np.exp(self.weights.tie), np.exp(self.weights.tie.T)]
        message = np.zeros((2 * n, L))
        belief = unary.copy()
        live = np.arange(2 * n)
        for _ in range(self.rules.most_rounds if n else 0):
            out = belief[src[live]] - message[back[live]]
            out = np.exp(out - out.max(1, keepdims=True))
            new = np.empty_like(out)
            for t, weights in enumerate(tables):
                chosen = which[live] == t
                new[chosen] = np.log(out[chosen] @ weights)
            new -= new.max(1, keepdims=True)
            new = 0.5 * message[live] + 0.5 * new
            change = np.zeros(self.n_graphs)
            np.maximum.at(change, graph[dst[live]], np.abs(new - message[live]).max(1))
            np.add.at(belief, dst[live], new - message[live])
            message[live] = new
            live = live[change[graph[dst[live]]] > self.rules.residual]  # a document's rounds depend on nothing but itself
            if not len(live):
                break
        return _soft(belief, 1)[1]


def plausible(kind: str, piece: str, p: FieldRules = FieldRules()) -> bool:
    n = len(only_digits(piece))
    if kind == "email":
        return "@" in piece or any(w in piece.lower() for w in AT_WORDS)
    if kind == "phone":
        return 7 <= n <= 15
    if kind == "card":
        return 12 <= n <= 19
    if kind == "ip":
        return n >= 4 and piece.count(".") == 3
    if kind == "id":
        return n >= 4 and len(piece) <= p.id_chars
    return n == 0 and any(c.isalpha() for c in piece)


def stretches(text: str, spans: list[tuple[int, int]], labels: list[int], taken: list[tuple[int, int]], p: FieldRules = FieldRules()) -> Iterator[tuple[str, int, int]]:
    """Tokens in a row with one label, without marks around them. A comma, a line break and a taken span end a stretch; one
    that is no plausible whole is given token by token. spans: of the tokens; labels: 0 for those that aren't looked at."""

    def bare(a: int, b: int) -> tuple[int, int]:
        while a < b and text[a] in EDGE and text[a] != "(":
            a += 1
        while a < b and text[b - 1] in EDGE and text[b - 1] not in ")]":
            b -= 1
        return a, b

    runs: list[list[int]] = []
    t = 0
    for k, (a, b) in enumerate(spans):
        while t < len(taken) and taken[t][1] <= a:
            t += 1
        if not labels[k] or (t < len(taken) and taken[t][0] < b):
            continue
        if runs and runs[-1][-1] == k - 1 and labels[k - 1] == labels[k] and text[spans[k - 1][1] - 1] not in ",;" and "\n" not in text[spans[k - 1][1] : a]:
            runs[-1].append(k)
        else:
            runs.append([k])
    for run in runs:
        kind = LABELS[labels[run[0]]]
        whole = bare(spans[run[0]][0], spans[run[-1]][1])
        parts = [whole] if plausible(kind, text[slice(*whole)], p) else [bare(*spans[k]) for k in run]
        yield from ((kind, *x) for x in parts if x[0] < x[1] and plausible(kind, text[slice(*x)], p))


def found_spans(texts: list[str | None], weights: Weights | None = None, p: FieldRules = FieldRules()) -> list[tuple[list, list]]:
    """For each text: base spans, and those that the field adds; none of these overlaps a base one."""
    field = Field(weights or trained(), p)
    base, held = [], []
    for text in texts:
        text = text or ""
        base.append(base_spans(text))
        held.append(None)
        if re.search(r"[0-9@]", text) or not CUE_TOKENS.isdisjoint(text.split()):
            matches = list(TOKEN.finditer(text))
            tokens = [m[0] for m in matches]
            at, forms, named = nodes_of(tokens, p)
            if at:
                held[-1] = (field.add(tokens, at, forms, named), at, [m.span() for m in matches])
    labels = field.marginals().argmax(1)
    out = []
    for text, own, h in zip(texts, base, held):
        added = []
        if h:
            first, at, spans = h
            said = [0] * len(spans)
            for k, i in enumerate(at):
                said[i] = int(labels[first + k])
            if any(said):
                added = list(stretches(text, spans, said, sorted((a, b) for _, a, b in own), p))
        out.append((own, added))
    return out


def written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (ORDER[s[0]], s[1], s[2])))


SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, text: str = "text", batch_chars: int = 4_000_000, p: FieldRules = FieldRules()) -> DataFrame:
    """Each row of docs with: base and added, arrays of (kind, start, end) in code points, end exclusive.

    A null or empty text has none. Repeated rows each get the same. Columns of the input with the name of a result are
    replaced; others stay, whatever their names. batch_chars: the texts whose graphs are held together; it doesn't change
    results. p: the field's bounds, which decide labels (FieldRules). Texts are read whole; the longest one's graph bounds a
    task's memory. Equal spans of two labels don't occur: a token has one, and of labels as likely the first in LABELS.
    No documents, no rows.
    """
    weights = trained()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def work(column: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        texts = column.to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < batch_chars):
                size += len(texts[end] or "")
                end += 1
            found = found_spans(texts[at:end], weights, p)
            yield at, end, [pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in side] for side in sides], kind) for sides in zip(*found)]
            at = end

    return map_rows(docs, text, f"base {SPANS}, added {SPANS}", work)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    rank = F.create_map(*[x for k, i in ORDER.items() for x in (F.lit(k), F.lit(i))])
    sorted_ = lambda c: F.array_sort(F.transform(c, lambda s: F.struct(rank[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    line = lambda c: F.array_join(F.transform(sorted_(c), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *map(count, KINDS), F.sha2(line(F.col("base")), 256).alias("base_sha256"), line(F.concat("base", "added")).alias("spans"))
