"""A classifier of message templates, fitted on the corpus in parts.

Softmax regression over the words of a template, neighbouring words, and its ends.  Labels come from phrase rules (templates
they judge, and those they leave as content) and from the fixed list of well-known messages below; what is learnt is which
wordings go with each kind, so that templates no rule knows are judged too.  The classifier of the corpus has the mean weights of
those of its parts, a feature that a part lacks counting as 0 there, and the sum of their word counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd

KINDS = ("content", "script", "error", "filler")
VARIABLE = "x1"
#: A template is residue if content is no likelier than this.
DOUBT = 0.6
#: and if this share of its words, at least, is at home in residue that the rules or the list know: no rarer there than ``HOME``
#: times as in content.
TOLD, HOME = 0.6, 0.25
ROUNDS, RATE, DECAY = 150, 0.5, 1e-4
#: What a message of the list weighs in the fit.
KNOWN_WEIGHT = 6.0
#: A classifier as rows: weights of features in units of ``1 / UNIT``, so that sums do not hang on their order; counts of words
#: (as content and as script, that is residue), and under no word those of templates and, as error, of parts.
MODEL = "name string, word boolean, content long, script long, error long, filler long"
UNIT = 1 << 32

# Messages of browsers, servers and publishing systems that anyone may meet, folded, a number as 0.
KNOWN: dict[str, tuple[str, ...]] = {
    "script": (
        "you must turn javascript on", "your browser does not support javascript", "javascript is required to view this site", "javascript must be enabled in order to use this page", "please turn on javascript and reload the page",
        "this site works best with javascript enabled", "we have detected that javascript is disabled in your browser", "you need to enable javascript to run this app", "scripts are blocked by your browser", "enable scripts in your browser settings and refresh",
        "it appears that javascript is disabled", "this content requires javascript", "to use this feature turn javascript on in your browser", "your browser has scripting turned off",
    ),
    "error": (
        "error establishing a database connection", "access to this page has been denied", "the requested url was not found on this server", "the page you are looking for might have been removed had its name changed or is temporarily unavailable", "this page is not available",
        "sorry this page could not be found", "oops that page can not be found", "something went wrong please try again", "an error occurred while processing your request", "the server encountered an internal error and was unable to complete your request",
        "the server is temporarily unable to service your request due to maintenance downtime or capacity problems", "your request could not be processed", "we are unable to load this content", "the connection to the server timed out", "this site can not be reached",
        "you do not have permission to access this resource", "you are not authorized to view this page", "login required to view this content", "your session has timed out please log in again", "too many requests please slow down",
        "the service is currently unavailable", "the page has been moved or deleted", "this item is no longer available", "failed to load resource", "unable to connect to the server", "could not connect to database", "unexpected token in json", "syntax error near unexpected token",
        "please try again later", "please check the address and try again", "reload the page or go back", "the server took too long to respond", "no such file or directory", "permission denied", "connection refused", "this request was blocked by the security rules", "checking your browser before accessing",
        "le service est indisponible", "une erreur est survenue", "der dienst ist nicht verfugbar", "es ist ein fehler aufgetreten", "el servicio no esta disponible", "se ha producido un error", "сервис временно недоступен", "произошла ошибка",
    ),
    "filler": (
        "content coming soon", "this page is under construction", "to be announced", "to be determined", "insert title here", "insert text here", "your text here", "add your content here", "enter a short description here", "type a short text at this place",
        "put your heading in this place", "description not available yet", "not written yet", "will be added later", "details to come", "abstract to be written", "section is empty", "no content yet", "placeholder text for the layout", "sample text please replace", "replace this text with your own",
        "this is dummy content", "dear name", "dear customer name", "click to edit this text", "double click to add text", "text folgt", "inhalt folgt", "texte a venir", "contenu a venir", "texto pendiente", "скоро будет", "текст будет добавлен",
    ),
}


def features(template: str) -> list[str]:
    """Words, pairs of neighbours, and pairs with one word between; variables only where they are neighbours."""
    w = ["^", *template.split(" "), "$"]
    out = [x for x in w if x != VARIABLE]
    out += [f"{a} {b}" for a, b in zip(w, w[1:])]
    out += [f"{a} . {b}" for a, b in zip(w, w[2:]) if VARIABLE not in (a, b)]
    variables = w.count(VARIABLE)
    return [*out, f"#{min(4, variables)}", f"#{min(5, variables * 5 // len(w))}/5"]


def plain(template: str, known: frozenset[str]) -> str:
    """A template in which all unknown words are variables."""
    return " ".join(w if w in known or w == "0" else VARIABLE for w in template.split(" "))


class Classifier:
    def __init__(self, rows: Iterable[tuple[str, str | None, float]], known: frozenset[str]):
        """``rows``: template, kind (None for content), weight.  Deterministic."""
        self.known = known
        given = [*((t, KINDS.index(k or "content"), n) for t, k, n in rows), *((t, KINDS.index(k), KNOWN_WEIGHT) for k, ts in KNOWN.items() for t in ts)]
        self.said = [Counter(w for t, k, _ in given if bool(k) == side for w in set(t.split(" "))) for side in (False, True)]
        self.share = [sum(bool(k) == side for _, k, _ in given) for side in (False, True)]
        self._tell()
        self.ids: dict[str, int] = {}
        x = [[self.ids.setdefault(f, len(self.ids)) for f in features(t)] for t, _, _ in given]
        self.weights = np.zeros((len(self.ids), len(KINDS)))
        label = np.eye(len(KINDS))[[k for _, k, _ in given]]
        weight = np.array([n for _, _, n in given])[:, None]
        flat, row = np.fromiter((f for r in x for f in r), dtype=np.int64), np.repeat(np.arange(len(x)), [len(r) for r in x])
        starts = np.searchsorted(row, np.arange(len(x)))
        order = np.argsort(flat, kind="stable")
        firsts = np.searchsorted(flat[order], np.arange(len(self.ids)))
        size = np.sqrt(np.diff([*starts, len(row)]))[:, None]
        place, squares = row[order], np.full_like(self.weights, 1e-6)
        for _ in range(ROUNDS):
            p = self._softmax(np.add.reduceat(self.weights[flat], starts) / size)
            error = weight * (p - label) / size
            slope = np.add.reduceat(error[place], firsts) + DECAY * weight.sum() / len(x) * self.weights
            squares += slope * slope
            self.weights -= RATE * slope / np.sqrt(squares)

    def _tell(self) -> None:
        share = [max(1, n) for n in self.share]
        self.told = {w for w, n in self.said[1].items() if n / share[1] >= HOME * self.said[0][w] / share[0]} - {VARIABLE}

    def model(self) -> pd.DataFrame:
        features_ = pd.DataFrame(np.rint(self.weights * UNIT).astype(np.int64), columns=list(KINDS)).assign(name=list(self.ids), word=False)
        words = [("", *self.share), *((w, self.said[0][w], self.said[1][w]) for w in self.said[0].keys() | self.said[1].keys())]
        counts = pd.DataFrame(words, columns=["name", "content", "script"]).assign(word=True, error=[1] + [0] * (len(words) - 1), filler=0)
        return pd.concat([features_, counts])[["name", "word", *KINDS]]

    @classmethod
    def mean(cls, rows: Iterable[tuple], known: frozenset[str]) -> Classifier:
        """From the sums of the models of parts."""
        rows = sorted(rows)
        totals = [r for r in rows if r[1] and not r[0]]
        if not totals:
            return cls([], known)
        made = cls.__new__(cls)
        made.known, made.share = known, list(totals[0][2:4])
        made.said = [Counter({r[0]: r[2 + side] for r in rows if r[1] and r[0] and r[2 + side]}) for side in (0, 1)]
        own = [r for r in rows if not r[1]]
        made.ids = {r[0]: k for k, r in enumerate(own)}
        made.weights = np.array([r[2:] for r in own], dtype=float) / UNIT / totals[0][4]
        made._tell()
        return made

    @staticmethod
    def _softmax(scores: np.ndarray) -> np.ndarray:
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def plain(self, template: str) -> str:
        return plain(template, self.known)

    def kind(self, template: str) -> str | None:
        template = self.plain(template)
        words = [w for w in template.split(" ") if w != VARIABLE]
        if sum(w in self.told for w in words) < TOLD * max(1, len(words)):
            return None
        own = features(template)
        ids = [self.ids[f] for f in own if f in self.ids]
        if not ids:
            return None
        p = self._softmax(self.weights[ids].sum(axis=0, keepdims=True) / np.sqrt(len(own)))[0]
        return KINDS[1 + int(p[1:].argmax())] if p[0] <= DOUBT else None
