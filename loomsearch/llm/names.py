"""Spellings of person and organisation names: parts, and whether two spellings can be one name."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: Usual legal forms of organisations with their short forms.
LEGAL = {
    "corporation": "corp", "limited": "ltd", "incorporated": "inc", "company": "co", "gmbh": "", "sa": "", "plc": "", "llc": "", "llp": "", "ag": "", "kg": "", "bv": "", "nv": "",
    "spa": "", "srl": "", "sarl": "", "oy": "", "ab": "", "foundation": "fdn", "university": "univ uni", "institute": "inst", "association": "assn", "society": "soc",
}
#: Legal forms that are written out in several words.
LONG_FORMS = {"gesellschaft mb h": "gmbh", "gesellschaft mbh": "gmbh", "societe anonyme": "sa", "public limited company": "plc", "limited liability company": "llc"}
TITLES = frozenset("dr prof sir mr ms mrs md phd dame lord the".split())
#: What people type where a name is asked for, but that names nobody.
GENERIC = frozenset("hq staff editor founder the author owner director agency company firm group organisation organization office team press".split())
#: Words of descriptions that say nothing.
STOP = frozenset("the and for from with its has was are not based who which that this into over under about near off one two new old all any his her their our your".split())
_FORMS = {w: k for k, v in LEGAL.items() for w in v.split()}


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).lower() if not unicodedata.combining(c))


def near(a: str, b: str) -> bool:
    """Equal but for one letter put in, left out, changed or swapped with the next."""
    if a == b:
        return True
    if min(len(a), len(b)) < 4 or abs(len(a) - len(b)) > 1:
        return False
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    if len(a) > len(b):
        return a[n + 1 :] == b[n:]
    if len(a) < len(b):
        return a[n:] == b[n + 1 :]
    return a[n + 1 :] == b[n + 1 :] or (a[n : n + 2] == b[n : n + 2][::-1] and a[n + 2 :] == b[n + 2 :])


def _short_of(a: str, word: str) -> bool:
    """``a`` abbreviates ``word``: same first letter, its letters in the word's order."""
    if not a or len(a) >= len(word) or a[0] != word[0]:
        return False
    it = iter(word)
    return all(c in it for c in a)


@lru_cache(maxsize=4)
def _keys(words: frozenset[str]) -> frozenset[str]:
    return frozenset(d for w in words if len(w) >= 4 for d in deletions(w))


def is_given(word: str, common: frozenset[str]) -> bool:
    """The word is an initial, or stands beside many surnames, or is a misspelling of one that does."""
    return len(word) == 1 or word in common or (len(word) >= 4 and not _keys(common).isdisjoint(deletions(word)))


def parse_person(text: str, common: frozenset[str]) -> tuple[str, list[str]] | None:
    """(surname, given names as typed) of a spelling, None if it names nobody."""
    text = re.sub(r"\([^)]*\)", " ", fold(text))
    parts = [[w for w in re.findall(r"[^\W\d_]+", p) if w not in TITLES] for p in text.split(",")]
    parts = [p for p in parts if p]
    if not parts:
        return None
    words = [w for p in parts for w in p]
    if len(words) < 2 or all(w in GENERIC for w in words):
        return None
    if len(parts) > 1:
        return (parts[0][-1], parts[1]) if len(parts[0]) == 1 else (parts[0][-1], parts[0][:-1])
    rare = [n for n, w in enumerate(words) if len(w) >= 4 and not is_given(w, common)]
    at = rare[-1] if rare else len(words) - 1
    if len(rare) > 1 and rare[0] == 0 and rare[-1] == len(words) - 1 and len(words) == 2:
        at = 1
    return words[at], words[:at] + words[at + 1 :]


def given_level(a: str, b: str, forms: dict[str, frozenset[str]]) -> int:
    """2: the same given name as far as spelling goes; 1: one is an initial or a cut form; 0: different.

    ``forms`` are other forms of given names, as learned from united spellings.
    """
    if a == b:
        return 2 if len(a) > 1 else 1
    none: frozenset[str] = frozenset()
    if len(a) == 1 or len(b) == 1:
        one, other = (a, b) if len(a) == 1 else (b, a)
        # An initial can be that of another form too (D. for Dick).
        return 1 if any(f[0] == one for f in {other} | forms.get(other, none)) else 0
    if b in forms.get(a, none) or near(a, b):
        return 2
    if len(a) <= 4 and b.startswith(a) or len(b) <= 4 and a.startswith(b):
        return 1
    return 0


def person_level(a: tuple[str, list[str]], b: tuple[str, list[str]], forms: dict[str, frozenset[str]]) -> int | None:
    """Level of the first given name if the surnames are near, 0 on a conflict, None if not near."""
    if not near(a[0], b[0]):
        return None
    ga, gb = a[1], b[1]
    if not ga or not gb:
        return None
    level = given_level(ga[0], gb[0], forms)
    if level and len(ga) > 1 and len(gb) > 1 and not given_level(ga[1], gb[1], forms):
        return 0
    return level


def org_words(text: str, common: dict[str, int]) -> list[tuple[str, str]]:
    """(word, known word it is, is like or abbreviates) of an organisation's spelling.

    Known are legal forms and ``common`` words with their numbers of uses. The second is
    empty for other words, and has alternatives parted by | where an abbreviation leaves a
    choice. An acronym has no words.
    """
    if re.fullmatch(r"(?:[A-Z]\.?){2,5}", text.strip()):
        return []
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", re.sub(r"\([^)]*\)", " ", text))
    folded = fold(spaced).replace("'", "").replace("\u2019", "")
    dotted = set(re.findall(r"([^\W\d_]+)\.", folded))
    plain = " ".join(w for w in re.findall(r"[^\W\d_]+", folded) if w not in ("the", "of", "and"))
    for long, short in LONG_FORMS.items():
        plain = plain.replace(long, short)
    words = plain.split()
    out = []
    for w in words:
        w = _FORMS.get(w, w)
        if w in LEGAL:
            out.append((w, w))
            continue
        uses = common.get(w, 0)
        # An abbreviation is used less than the word; letters left out count only behind a full stop or in short words.
        short = [k for k, n in common.items() if (n > uses or w in dotted) and _short_of(w, k)] + [k for k in LEGAL if _short_of(w, k)] if len(w) <= 6 and (w in dotted or len(words) > 1) else []
        starts = [k for k in short if k.startswith(w)] or (short if w in dotted or not uses else [])
        alike = [k for k in (*LEGAL, *common) if len(w) >= 5 and k != w and near(w, k) and common.get(k, 1 << 30) > uses]
        if w in dotted and starts:
            out.append((w, "|".join(sorted(set(starts)))))
        elif uses or (starts and not alike):
            out.append((w, "|".join(sorted({*starts, *([w] if uses else [])}))))
        else:
            out.append((w, alike[0] if alike else ""))
    return out


def parse_org(text: str, common: dict[str, int]) -> tuple[str, list[str]] | None:
    """(own name, known words) of a spelling; own name "" with its letters for an acronym."""
    if re.fullmatch(r"(?:[A-Z]\.?){2,5}", text.strip()):
        return "", [re.sub(r"\W", "", fold(text))]
    words = org_words(text, common)
    own = [w for w, known in words if not known]
    if not own:
        # Where all words are known, the rarest that is no legal form is the own name.
        own = sorted((w for w, known in words if w not in LEGAL), key=lambda w: (common.get(w, 0), -len(w)))[:1]
    if not own or (len(own) == 1 and own[0] in GENERIC):
        return None
    return max(own, key=len), [known or w for w, known in words if w not in own]


def unknown_words(kind: str, text: str) -> list[str]:
    """Words of a spelling that no fixed table knows, each once; an abbreviation keeps its full stop out."""
    if kind == "Person":
        found = re.findall(r"[^\W\d_]+", re.sub(r"\([^)]*\)", " ", fold(text)))
    else:
        found = [w for w, known in org_words(text, {}) if not known]
    return sorted({w for w in found if len(w) > 1 and w not in TITLES | GENERIC})


def _same_word(x: str, y: str) -> bool:
    return bool(set(x.split("|")) & set(y.split("|")))


def org_level(a: tuple[str, list[str]], b: tuple[str, list[str]]) -> int | None:
    """2: near own names, a known word shared and none against it; 1: no word shared; 0: legal forms differ,
    or each has other words that the other lacks; None: the own names are not near."""
    if not a[0] or not b[0] or not near(a[0], b[0]):
        return None
    lacks = []
    for legal in (True, False):
        x, y = ([w for w in f[1] if (not set(w.split("|")).isdisjoint(LEGAL)) == legal] for f in (a, b))
        lacks.append(([w for w in x if not any(_same_word(w, v) for v in y)], [w for w in y if not any(_same_word(w, v) for v in x)]))
    if any(x and y for x, y in lacks):
        return 0
    return 2 if any(_same_word(x, y) for x in a[1] for y in b[1]) else 1


def spellings_in(text: str | None) -> list[str]:
    """Runs of two or more capitalised words of a description."""
    return re.findall(r"[^\W\d_a-z][^\W\d_]*(?:[ .-]+[^\W\d_a-z][^\W\d_]*)+", text or "")


def deletions(word: str) -> list[str]:
    """Keys that two words share if they are near."""
    return sorted({word, *(word[:k] + word[k + 1 :] for k in range(len(word)))})
