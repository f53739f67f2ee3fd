"""Reading component texts: kind with its variety, nominal sizes, material, rating (for problem 3).

Plain functions on single values, used through Arrow batches; tokens are corrected against a
small lexicon and cached, so misspelt descriptions cost no more than right ones.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Words of component descriptions, usual short forms, and what they stand for.
WORDS = {
    "pipe": "pipe tube", "elbow": "elbow elbo ell", "tee": "tee", "reducer": "reducer redu", "cap": "cap", "olet": "olet", "weldolet": "weldolet",
    "sockolet": "sockolet", "threadolet": "threadolet", "coupling": "coupling cplg", "nipple": "nipple", "union": "union", "flange": "flange flg flan",
    "blind": "blind blank bld", "spectacle": "spectacle spec spade", "figure": "figure fig", "gasket": "gasket gskt gask", "strainer": "strainer strnr",
    "valve": "valve vlv valv", "gate": "gate", "ball": "ball", "globe": "globe", "check": "check nrv chk nonreturn", "return": "return", "butterfly": "butterfly bfly",
    "plug": "plug", "needle": "needle ndl", "diaphragm": "diaphragm", "control": "control", "relief": "relief", "safety": "safety",
    "concentric": "concentric conc", "eccentric": "eccentric ecc", "equal": "equal eq straight", "reducing": "reducing reduced red",
    "long": "long lr", "short": "short sr", "radius": "radius rad", "half": "half", "full": "full", "weld": "weld", "socket": "socket", "neck": "neck",
    "wn": "wn wnrf", "so": "so", "slip": "slip", "lap": "lap", "shoe": "shoe", "support": "support", "hanger": "hanger", "guide": "guide", "clamp": "clamp",
    "gauge": "gauge", "element": "element", "thermowell": "thermowell", "expansion": "expansion exp", "bellows": "bellows", "adapter": "adapter", "swivel": "swivel",
    "fitting": "fitting", "handle": "handle", "type": "type", "special": "special", "bore": "bore", "seamless": "seamless smls", "swing": "swing", "wafer": "wafer",
    "raised": "raised", "face": "face", "butt": "butt", "flanged": "flanged flgd", "screwed": "screwed scrd", "spiral": "spiral", "wound": "wound", "welded": "welded",
    "single": "single", "joint": "joint jt", "orifice": "orifice", "flow": "flow", "temperature": "temperature", "pressure": "pressure", "spring": "spring", "hose": "hose",
    "holes": "holes", "bolt": "bolt", "ends": "ends", "bevelled": "bevelled", "swage": "swage", "graphite": "graphite graph fg", "mica": "mica", "ptfe": "ptfe", "outer": "outer", "inner": "inner",
    "stud": "stud studbolt", "plate": "plate", "anchor": "anchor", "trunnion": "trunnion",
}
#: Steel families of material grades: carbon, low temperature, stainless.
GRADES = {
    "carbon": "a234 wpb a105 a105n a106 a216 wcb a516 a53",
    "low": "a420 wpl6 a350 lf2 a333 a352 lcb a537 ltcs",
    "stainless": "a403 wp316l a182 f316l a312 a351 cf8m a240 tp316l 316l ss316l wp304l f304l tp304l 304l",
}
#: Nominal size in inches (in eighths) to DN.
EIGHTHS_TO_DN = {1: 6, 2: 8, 3: 10, 4: 15, 6: 20, 8: 25, 10: 32, 12: 40, 16: 50, 20: 65, 24: 80, 28: 90, 32: 100, 40: 125, 48: 150}
# End of fixed values.
# From 8 inches on a nominal size is 25 mm an inch.
EIGHTHS_TO_DN |= {8 * i: 25 * i for i in range(8, 49, 2)}
DNS = set(EIGHTHS_TO_DN.values())

_LEX = {w: k for k, ws in WORDS.items() for w in ws.split()}
_FAMILY = {g: f for f, gs in GRADES.items() for g in gs.split()}


def slip(a: str, b: str) -> bool:
    """Whether one letter added, dropped or changed, or two neighbours swapped, make ``a`` of ``b``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:])


@lru_cache(200_000)
def word(t: str) -> str:
    """The lexicon's word of a token, itself if it is none of them or a slip from more than one."""
    if t in _LEX:
        return _LEX[t]
    if t.endswith("s") and t[:-1] in _LEX:
        return _LEX[t[:-1]]
    if len(t) < 3 or not t.isalpha():
        return t
    near = readings(t)
    return near[0] if len(near) == 1 else t


@lru_cache(200_000)
def readings(t: str) -> list[str]:
    """Words of the lexicon that are a slip away, those of four letters and more first."""
    return sorted({_LEX[w] for w in _LEX if len(w) >= 4 and slip(t, w)} or {_LEX[w] for w in _LEX if len(w) == 3 and slip(t, w)})


_JOINED = [(re.compile(p), r) for p, r in ((r"\b([a-z])\.([a-z])\.?(?![a-z])", r"\1\2"), (r"\b(\w+)-o-l(\w+)", r"\1ol\2"), (r"\bo-let", "olet"), (r"\bnon[- ]return", "nonreturn"), (r"\bb'?fly", "bfly"), (r"\bslip[- ]on", "slip on"), (r"(?<=\d)deg", " deg"))]


@lru_cache(200_000)
def words(text: str) -> tuple[str, ...]:
    t = text.lower()
    for p, r in _JOINED:
        t = p.sub(r, t)
    return tuple(word(x) for x in re.findall(r"[a-z]+|\d+", t))


VALVES = ("gate", "ball", "globe", "check", "butterfly", "plug", "needle", "diaphragm", "control", "relief", "safety")
#: Components that are neither fitting, flange nor valve, the more telling word first.
OTHERS = ("expansion", "bellows", "shoe", "hanger", "guide", "clamp", "anchor", "trunnion", "gauge", "element", "thermowell", "adapter", "swivel", "support")


@lru_cache(200_000)
def kind(text: str | None) -> str:
    """Kind of a component with its variety, such as "elbow 90 long"; '' if the text names none.

    A variety that the text leaves open is "?": it agrees with none. A token that is a slip away from several
    words is read as each of them until the kind is complete.
    """
    if not text:
        return ""
    ws = words(text)
    found = _kind(ws)
    if found and "?" not in found:
        return found
    for i, w in enumerate(ws):
        if w not in WORDS and len(w) >= 3 and w.isalpha():
            for r in readings(w):
                k = _kind((*ws[:i], r, *ws[i + 1 :]))
                if k and "?" not in k and k.split(" ")[0] not in OTHERS:
                    return k
    return found


def _kind(ws: tuple[str, ...]) -> str:
    has = set(ws)
    if other := next((o for o in OTHERS if o in has), None):
        if other == "gauge":
            return f"gauge {next((w for w in ws if w in ('pressure', 'temperature', 'flow')), '?')}"
        return "expansion" if other == "bellows" else other
    if "spectacle" in has or ("figure" in has and "8" in has):
        return "spectacle blind"
    first = next((w for w in ws if w in VALVES), "check" if "return" in has else None)
    if first and ("valve" in has or first not in ("control",)):
        return f"valve {'relief' if first == 'safety' else first}"
    pick = lambda *opts: next((o for o in opts if o in has), "?")
    if "elbow" in has:
        angle = next((w for w in ws if w in ("45", "90", "180")), "?")
        radius = pick("long", "short")
        return f"elbow {angle} {'long' if angle == '45' and radius == '?' else radius}"
    if "tee" in has:
        return f"tee {pick('equal', 'reducing')}"
    if "reducer" in has or "swage" in has:
        return f"reducer {pick('concentric', 'eccentric')}"
    for o in ("weldolet", "sockolet", "threadolet"):
        if o in has:
            return f"olet {o}"
    if "olet" in has:
        return f"olet {'weldolet' if 'weld' in has and 'socket' not in has else 'sockolet' if 'socket' in has else '?'}"
    if "coupling" in has:
        return f"coupling {pick('half', 'full')}"
    if "union" in has:
        return "union"
    if "nipple" in has:
        return "nipple"
    if "cap" in has:
        return "cap"
    if "gasket" in has:
        return "gasket"
    if "strainer" in has:
        return "strainer"
    if "flange" in has:
        if "blind" in has:
            return "flange blind"
        if "orifice" in has:
            return "flange orifice"
        if "wn" in has or "neck" in has:
            return "flange neck"
        return f"flange {'slip' if 'so' in has or 'slip' in has else 'lap' if 'lap' in has else 'socket' if 'socket' in has else '?'}"
    if "valve" in has:
        return "valve ?"
    if "blind" in has:
        return "flange blind"
    if "orifice" in has and "plate" in has:
        return "orifice plate"
    if "pipe" in has:
        return "pipe"
    return "stud bolt" if "bolt" in has else ""


_NUM = r"\d+\s*\.\s*\d+\s*/\s*\d+|\d\s+\d+/\d+|\d-\d+/\d+|\d+/\d+|\d+\.\d+|\d+"
_ONE = rf"(?:dn\s*\d+|(?:{_NUM})\s*(?:nb|mm|inch(?![a-wyz])|in(?![a-wyz])\.?|\"|''))"
_BARE = rf"(?:dn\s*)?(?:{_NUM})\s*(?:nb|mm|inch(?![a-wyz])|in(?![a-wyz])\.?|\"|'')?"
_COLUMN = re.compile(rf"^\s*({_BARE})(?:\s*[x×]\s*({_BARE}))?(?:\s*[x×]\s*({_BARE}))?\s*$")
_IN_TEXT = re.compile(rf"(?<![\w.#/-])({_ONE})(?:\s*[x×]\s*({_BARE}))?(?![\w#])")
_PAIR = re.compile(r"(?<![\w.#/-])(\d+)\s*[x×]\s*(\d+)(?![\w#])")
_LAST = re.compile(r"\s(\d{2,3})\s*$")
_FIRST = re.compile(r"^\s*(\d{2,3})\s+(?!deg|°)")


def dn(text: str, inches: bool = False) -> int | None:
    """DN of one size notation; a bare number is a DN if it is one, else inches."""
    t = text.strip().lower()
    m = re.search(r"(\d+)\s*\.\s*(\d+)\s*/\s*(\d+)|(\d+)[ -]+(\d+)/(\d+)|(\d+)/(\d+)|(\d+\.\d+)|(\d+)", t)
    if not m:
        return None
    g = m.groups()
    if g[0] or g[3]:
        a, b, c = (g[0:3] if g[0] else g[3:6])
        v = int(a) + int(b) / max(1, int(c))
    elif g[6]:
        v = int(g[6]) / max(1, int(g[7]))
    else:
        v = float(g[8] or g[9])
    metric = "dn" in t or "nb" in t or "mm" in t
    imperial = '"' in t or "''" in t or re.search(r"\d\s*in", t) or g[0] or g[3] or g[6] or inches
    if metric or (not imperial and v >= 6 and v in DNS):
        return int(v) if v == int(v) and int(v) in DNS else None
    return EIGHTHS_TO_DN.get(int(v * 8)) if v * 8 == int(v * 8) else None


@lru_cache(200_000)
def sizes(column: str | None, text: str | None, of: str = "") -> tuple[int, ...]:
    """Nominal sizes (DN, largest first): from the size column or, where it holds none, from the description."""
    c = (column or "").lower().replace(" ", " ")
    found: list[int | None] = []
    m = _COLUMN.match(c)
    if m:
        # "8"x6": a bare number after inches is in inches too
        inch = bool(re.search(r"[\"']|\din|\d\s+in", m[1]))
        found = [dn(m[1])] + [dn(x, inches=inch and not re.search(r"dn|nb|mm", x)) for x in m.groups()[1:] if x]
    elif text:
        t = text.lower().replace(" ", " ")
        hits = [h for h in _IN_TEXT.finditer(t) if not re.match(r"m\d", h[1])]
        if hits:
            h = hits[0] if hits[0].start() < 2 else hits[-1]
            inch = bool(re.search(r"[\"']|\din|\d\s+in", h[1]))
            found = [dn(h[1])] + ([dn(h[2], inches=inch and not re.search(r"dn|nb|mm", h[2]))] if h[2] else [])
        elif p := _PAIR.search(t):
            found = [dn(p[1]), dn(p[2])]
        else:
            # a bare number at either end is the size, unless it must be the rating
            rated = of.split(" ")[0] not in ("flange", "valve", "strainer", "spectacle", "gasket", "") or rating(t) or len(re.findall(r"(?<![\w.-])\d+", t)) > 1
            for b in (_LAST.search(t), _FIRST.match(t)):
                if b and int(b[1]) in DNS and (rated or int(b[1]) not in (150, 300, 600)):
                    found = [int(b[1])]
                    break
    if not found or any(f is None for f in found):
        return ()
    return tuple(sorted({f for f in found if f}, reverse=True))


@lru_cache(200_000)
def material(column: str | None, text: str | None, of: str) -> str:
    """Steel family, or for a gasket its filler; '' if neither text tells. The column comes first."""
    for t in (column, text):
        if not t:
            continue
        toks = re.findall(r"[a-z]+\d*[a-z]*|\d+[a-z]*", re.sub(r"\bgr\b\.?|\bastm\b", " ", t.lower()))
        if of == "gasket":
            for w in (word(x) for x in toks):
                if w in ("graphite", "mica", "ptfe"):
                    return w
            continue
        fams = [_FAMILY[x] for x in toks if x in _FAMILY]
        if fams:
            return fams[0] if "low" not in fams else "low"
        if t is column and re.search(r"\bcs\b", t.lower()):
            return "carbon"
        if t is column and re.search(r"\bss\b", t.lower()):
            return "stainless"
    return ""


def rating(text: str | None) -> str:
    m = re.search(r"\b(?:cl|class)\s*(\d{3,4})\b|\b(\d{3,4})\s*(?:#|lb)", (text or "").lower())
    return (m[1] or m[2]) if m else ""
