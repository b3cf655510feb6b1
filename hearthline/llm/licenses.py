"""License scan: ordered signature rules behind a keyword gate, overlaps resolved by priority and containment."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import each, plain_words, text_udf

#: Fixed phrases whose labels always stand.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: label | key words | name | SPDX identifiers | address. Patterns are over lower-case words joined by
#: one space, so "2.0" reads "2 0". Hand-written; the forms below make several rules of each line.
FAMILIES = """
mit | mit | (?:mit|expat) licen[cs]e | mit | opensource org licenses mit
mit-0 | mit 0 | mit no attribution(?: licen[cs]e)?|mit 0 | mit 0 | opensource org licenses mit 0
mit-modern | mit modern | mit licen[cs]e modern variant | mit modern variant |
apache-1 | apache | apache (?:software )?licen[cs]e(?: version)? 1 [01] | apache 1 [01] | apache org licenses license 1 [01]
apache-2 | apache | apache (?:software )?licen[cs]e(?: version| v)? ?2(?: 0)? | apache 2 0 | apache org licenses license 2 0
apache | apache | apache (?:software )?licen[cs]e | apache | apache org licenses
bsd-2-clause | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd)(?: simplified)?(?: licen[cs]e)? | bsd 2 clause | opensource org licenses bsd 2 clause
bsd-3-clause | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)(?: licen[cs]e)? | bsd 3 clause | opensource org licenses bsd 3 clause
bsd-4-clause | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd)(?: licen[cs]e)? | bsd 4 clause | directory fsf org wiki license bsd 4clause
bsd-0 | 0bsd | 0bsd|zero clause bsd(?: licen[cs]e)? | 0bsd | opensource org licenses 0bsd
bsd | bsd | bsd(?: style)? licen[cs]e | bsd | opensource org licenses bsd license
isc | isc | isc licen[cs]e | isc | opensource org licenses isc
gpl-1 | general public | gnu general public licen[cs]e(?: version| v) 1(?: 0)? | gpl 1 0(?: only| or later)? | gnu org licenses gpl 1 0
gpl-2 | general public | gnu general public licen[cs]e(?: version| v)? ?2(?: 0)? | gpl 2 0(?: only| or later)? | gnu org licenses(?: old licenses)? gpl 2 0
gpl-3 | general public | gnu general public licen[cs]e(?: version| v)? ?3(?: 0)? | gpl 3 0(?: only| or later)? | gnu org licenses gpl 3 0
gpl-2-short | gplv2 | (?:gnu )?gplv2 | gplv2 | gnu org licenses gplv2
gpl-3-short | gplv3 | (?:gnu )?gplv3 | gplv3 | gnu org licenses gplv3
gpl | general public | gnu general public licen[cs]e | gpl | gnu org licenses gpl
lgpl-2 | general public | gnu library general public licen[cs]e(?: version| v)? ?2(?: 0)? | lgpl 2 0(?: only| or later)? | gnu org licenses(?: old licenses)? lgpl 2 0
lgpl-2.1 | general public | gnu lesser general public licen[cs]e(?: version| v)? ?2 1 | lgpl 2 1(?: only| or later)? | gnu org licenses(?: old licenses)? lgpl 2 1
lgpl-3 | general public | gnu lesser general public licen[cs]e(?: version| v)? ?3(?: 0)? | lgpl 3 0(?: only| or later)? | gnu org licenses lgpl 3 0
lgpl | general public | gnu (?:lesser|library) general public licen[cs]e | lgpl | gnu org licenses lgpl
agpl-3 | affero | gnu affero general public licen[cs]e(?: version| v)? ?3(?: 0)? | agpl 3 0(?: only| or later)? | gnu org licenses agpl 3 0
agpl-1 | affero | affero general public licen[cs]e(?: version| v)? ?1(?: 0)? | agpl 1 0(?: only| or later)? | affero org oagpl
agpl | affero | (?:gnu )?affero general public licen[cs]e | agpl | gnu org licenses agpl
gfdl-1.2 | documentation | gnu free documentation licen[cs]e(?: version| v)? ?1 2 | gfdl 1 2(?: only| or later)? | gnu org licenses(?: old licenses)? fdl 1 2
gfdl-1.3 | documentation | gnu free documentation licen[cs]e(?: version| v)? ?1 3 | gfdl 1 3(?: only| or later)? | gnu org licenses fdl 1 3
gfdl | documentation | gnu free documentation licen[cs]e | gfdl | gnu org licenses fdl
mpl-1 | mozilla | mozilla public licen[cs]e(?: version| v)? ?1 [01] | mpl 1 [01] | mozilla org mpl 1 [01]
mpl-2 | mozilla | mozilla public licen[cs]e(?: version| v)? ?2(?: 0)? | mpl 2 0 | mozilla org (?:en us )?mpl 2 0
mpl | mozilla | mozilla public licen[cs]e | mpl | mozilla org mpl
epl-1 | eclipse | eclipse public licen[cs]e(?: version| v)? ?1(?: 0)? | epl 1 0 | eclipse org legal epl v10
epl-2 | eclipse | eclipse public licen[cs]e(?: version| v)? ?2(?: 0)? | epl 2 0 | eclipse org legal epl (?:2 0|v20)
edl-1 | eclipse | eclipse distribution licen[cs]e | edl 1 0 | eclipse org org documents edl v10
cddl-1 | common development | common development and distribution licen[cs]e(?: version| v)?(?: 1 [01])? | cddl 1 [01] | opensource org licenses cddl1
cpl-1 | common public | common public licen[cs]e(?: version| v)?(?: 1 0)? | cpl 1 0 | opensource org licenses cpl1 0
ipl-1 | ibm | ibm public licen[cs]e(?: version| v)?(?: 1 0)? | ipl 1 0 | opensource org licenses ipl 1 0
eupl-1 | union | european union public licen[cs]e(?: version| v)?(?: 1 [012])? | eupl 1 [012] | joinup ec europa eu software page eupl
osl-3 | open software | open software licen[cs]e(?: version| v)?(?: [123] [01])? | osl [123] [01] | opensource org licenses osl 3 0
afl-3 | academic | academic free licen[cs]e(?: version| v)?(?: [123] [01])? | afl [123] [012] | opensource org licenses afl 3 0
artistic-1 | artistic | artistic licen[cs]e(?: version| v)? ?1 0 | artistic 1 0(?: perl| cl8)? | opensource org licenses artistic license 1 0
artistic-2 | artistic | artistic licen[cs]e(?: version| v)? ?2(?: 0)? | artistic 2 0 | opensource org licenses artistic license 2 0
artistic | artistic | artistic licen[cs]e | artistic | opensource org licenses artistic
bsl-1 | boost | boost software licen[cs]e(?: version| v)?(?: 1 0)? | bsl 1 0 | boost org license 1 0
busl-1.1 | business source | business source licen[cs]e(?: version| v)?(?: 1 1)? | busl 1 1 | mariadb com bsl11
sspl-1 | server side | server side public licen[cs]e(?: version| v)?(?: 1)? | sspl 1 0 | mongodb com licensing server side public license
elastic-2 | elastic | elastic licen[cs]e(?: version| v)?(?: ?2(?: 0)?)? | elastic 2 0 | elastic co licensing elastic license
zlib | zlib | zlib(?: libpng)? licen[cs]e | zlib | opensource org licenses zlib
libpng | libpng | libpng licen[cs]e(?: version 2)? | libpng(?: 2 0)? | libpng org pub png src libpng license
unlicense | unlicense | (?:the )?unlicense | unlicense | unlicense org
wtfpl | wtfpl | wtfpl(?: version 2)? | wtfpl | wtfpl net
psf-2 | python | (?:python software foundation|psf) licen[cs]e(?: agreement)?(?: version 2)? | psf 2 0 | docs python org license
python-2 | python | python licen[cs]e(?: version)? 2(?: 0)? | python 2 0 | opensource org licenses python 2 0
ruby | ruby | ruby licen[cs]e | ruby | ruby lang org en about license
php-3 | php | php licen[cs]e(?: version| v)?(?: 3 0[01]?)? | php 3 0[01]? | php net license 3 0
ncsa | ncsa | (?:university of illinois )?ncsa (?:open source )?licen[cs]e | ncsa | opensource org licenses ncsa
postgresql | postgresql | postgresql licen[cs]e | postgresql | opensource org licenses postgresql
openssl | openssl | openssl licen[cs]e | openssl | openssl org source license
curl | curl | curl licen[cs]e | curl | curl se docs copyright
x11 | x11 | x11 licen[cs]e | x11 | x org downloads terms
vim | vim | vim licen[cs]e | vim | vimdoc sourceforge net htmldoc uganda
ms-pl | microsoft public | microsoft public licen[cs]e | ms pl | opensource org licenses ms pl
ms-rl | microsoft reciprocal | microsoft reciprocal licen[cs]e | ms rl | opensource org licenses ms rl
upl-1 | universal permissive | universal permissive licen[cs]e(?: version| v)?(?: 1 0)? | upl 1 0 | oss oracle com licenses upl
cecill-2 | cecill | cecill(?: free software)?(?: licen[cs]e)?(?: agreement)?(?: version 2(?: [01])?)? | cecill (?:2 [01]|b|c) | cecill info licences
ofl-1 | font | (?:sil )?open font licen[cs]e(?: version| v)?(?: 1 [01])? | ofl 1 [01] | scripts sil org ofl
odbl-1 | database | open database licen[cs]e(?: version| v)?(?: 1 0)? | odbl 1 0 | opendatacommons org licenses odbl
odc-by-1 | commons attribution | open data commons attribution licen[cs]e(?: version| v)?(?: 1 0)? | odc by 1 0 | opendatacommons org licenses by
pddl-1 | domain dedication | (?:odc )?public domain dedication and licen[cs]e(?: version| v)?(?: 1 0)? | pddl 1 0 | opendatacommons org licenses pddl
cc0 | cc0 | cc0(?: 1 0)?(?: universal)? | cc0 1 0 | creativecommons org publicdomain zero 1 0
cc-by | cc by | cc by(?: [1234] [05])?|creative commons attribution(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported)? | cc by [1234] [05] | creativecommons org licenses by
cc-by-sa | cc sa | cc by sa(?: [1234] [05])? | cc by sa [1234] [05] | creativecommons org licenses by sa
cc-by-nd | cc nd | cc by nd(?: [1234] [05])? | cc by nd [1234] [05] | creativecommons org licenses by nd
cc-by-nc | cc nc | cc by nc(?: [1234] [05])? | cc by nc [1234] [05] | creativecommons org licenses by nc
cc-by-nc-sa | cc nc sa | cc by nc sa(?: [1234] [05])? | cc by nc sa [1234] [05] | creativecommons org licenses by nc sa
cc-by-nc-nd | cc nc nd | cc by nc nd(?: [1234] [05])? | cc by nc nd [1234] [05] | creativecommons org licenses by nc nd
cc-by-sa-name | sharealike | creative commons attribution share ?alike(?: licen[cs]e)?(?: [1234] [05])? | cc by sa | creativecommons org licenses by sa [1234]
cc-by-nc-name | noncommercial | creative commons attribution non ?commercial(?: licen[cs]e)?(?: [1234] [05])? | cc by nc | creativecommons org licenses by nc [1234]
cc-by-nd-name | noderivatives | creative commons attribution no ?deriv(?:ative)?s(?: licen[cs]e)?(?: [1234] [05])? | cc by nd | creativecommons org licenses by nd [1234]
llama-community | llama | llama [234] community licen[cs]e(?: agreement)? | llama[234] | ai meta com llama license
openrail | openrail | (?:creativeml |bigscience )?open ?rail(?: m)?(?: licen[cs]e)? | openrail | huggingface co spaces bigscience license
proprietary | rights reserved | all rights reserved | proprietary |
public-domain | public domain | (?:released|dedicated|placed) (?:in|into|to) the public domain | public domain | creativecommons org publicdomain mark 1 0
generic | licensed | licen[cs]ed under | other |
generic-grant | granted | permission is hereby granted free of charge | other permissive |
generic-warranty | warranty | without warranty of any kind | other warranty |
generic-redistribution | redistribution | redistribution and use in source and binary forms | other redistribution |
generic-copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9] | other copyright |
"""

#: form: prefix, words that must also occur, priority, weight. `{}` stands for the line's pattern.
FORMS = (
    ("spdx", "spdx license identifier {}", "spdx identifier", 50, 1.0),
    ("grant", "(?:licen[cs]ed|released|distributed|published|available|provided|redistributed) (?:only )?under"
     "(?: the)?(?: terms (?:and conditions )?of(?: the)?)? {}", "under", 40, 0.95),
    ("url", "(?:https? )?(?:www )?{}", "", 30, 0.9),
    ("version", "{}(?: only| or(?: \\(at your option\\))? any later(?: version)?| or later)", "", 35, 0.9),
    ("name", "{}", "", 20, 0.7),
)


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    pattern: re.Pattern
    gate: frozenset  # words that every alternative needs
    gates: tuple[frozenset, ...]  # any of these sets opens the rule
    priority: int
    weight: float
    base: bool


def _spelled(parsed) -> list[str]:
    """All texts that a parsed pattern of letters, classes, brackets and optional parts matches."""
    out = [""]
    for op, arg in parsed:
        kind = str(op)
        if kind == "LITERAL":
            ends = [chr(arg)]
        elif kind == "IN":
            ends = [chr(c) for k, x in arg for c in ([x] if str(k) == "LITERAL" else range(x[0], x[1] + 1))]
        elif kind == "BRANCH":
            ends = [x for part in arg[1] for x in _spelled(part)]
        elif kind == "SUBPATTERN":
            ends = _spelled(arg[-1])
        elif kind == "MAX_REPEAT" and arg[:2] == (0, 1):
            ends = ["", *_spelled(arg[2])]
        else:
            raise ValueError(f"no gate for {kind}")
        out = [a + b for a in out for b in ends]
    return out


def word_sets(pattern: str) -> list[frozenset]:
    """The least sets of words of which a text must hold one whole set for the pattern to match. Numbers and spellings
    of licence are left out where other words remain: a gate may open too often, never too seldom."""
    sets = set()
    for text in _spelled(re._parser.parse(pattern)):
        words = frozenset(text.encode().split())
        sets.add(frozenset(w for w in words if not w.isdigit() and not w.startswith((b"license", b"licence"))) or words)
    return [s for s in sets if not any(t < s for t in sets)]


def _rule(
    name: str, label: str, pattern: str, body: str, more: str, priority: int, weight: float, base: bool = False
) -> Rule:
    # neighbours are looked at, not consumed, so that places next to each other all count
    compiled = re.compile(f"(?<= )(?:{pattern})(?= )".encode())
    gates = tuple(s | frozenset(more.encode().split()) for s in word_sets(body))
    return Rule(name, label, compiled, frozenset.intersection(*gates), gates, priority, weight, base)


def signature_rules() -> list[Rule]:
    """All rules in order of priority: the fixed phrases, then every family in its forms."""
    rules = [_rule(f"base:{label}", label, phrase, phrase, "", 60, 1.0, True) for label, phrase in BASE_PHRASES]
    for line in FAMILIES.strip().splitlines():
        family, _, name, spdx, url = (x.strip() for x in line.split("|", 2)[:2] + _tail(line))
        label = re.sub(r"-(?:name|short|modern)$", "", family)
        for form, shape, more, priority, weight in FORMS:
            body = {"spdx": spdx, "url": url}.get(form, name)
            if body and not (form == "version" and not re.search(r"gpl|gfdl|mpl", family)):
                if family.startswith(("generic", "proprietary")):
                    priority, weight = 5, 0.3
                    if form != "name":
                        continue
                rules.append(_rule(f"{form}:{family}", label, shape.replace("{}", f"(?:{body})"), body, more, priority, weight))
    return sorted(rules, key=lambda r: -r.priority)


def _tail(line: str) -> list[str]:
    """Name, identifiers and address: the fields that may hold a `|` inside brackets are split on ` | ` only."""
    parts = [x.strip() for x in re.split(r" \|(?: |$)", line)]
    return (parts[2:] + ["", "", ""])[:3]


def resolve(found: list[tuple[int, int, int, int]]) -> list[bool]:
    """Suppressed or not, for (priority, length, first word, end word) each: going from high priority and long to low
    and short, a detection goes if an accepted one contains it. Equal intervals keep the first in this order."""
    order = sorted(range(len(found)), key=lambda i: (-found[i][0], -found[i][1], found[i][2], i))
    rank = {s: k + 1 for k, s in enumerate(sorted({x[2] for x in found}))}
    furthest = [-1] * (len(rank) + 1)  # Fenwick tree: the furthest accepted end among starts up to a rank
    out = [False] * len(found)
    for i in order:
        k = rank[found[i][2]]
        j, reach = k, -1
        while j:
            reach = max(reach, furthest[j])
            j -= j & -j
        out[i] = reach >= found[i][3]
        while not out[i] and k <= len(rank):
            furthest[k] = max(furthest[k], found[i][3])
            k += k & -k
    return out


DETECTIONS = (
    "n_words long, detections array<struct<rule:string,label:string,base:boolean,first_word:long,end_word:long,"
    "weight:double,suppressed:boolean>>"
)


def _scanner():
    rules = signature_rules()
    gates = frozenset().union(*(s for r in rules for s in r.gates))

    def scan(text: bytes) -> tuple:
        words = plain_words(text)
        seen = gates.intersection(words)
        found, norm = [], None
        if seen:
            for rule in rules:
                if any(map(seen.issuperset, rule.gates)):
                    norm = norm or b" " + b" ".join(words) + b" "
                    for m in rule.pattern.finditer(norm):
                        found.append((rule, m.start(), m.end()))
        if not found:
            return len(words), []
        # word numbers by one sweep over the sorted offsets
        at, number, last = {}, 0, 0
        for x in sorted({y for _, s, e in found for y in (s, e)}):
            number += norm.count(b" ", last, x)
            at[x], last = number, x
        spans = [(r, at[s] - 1, at[e]) for r, s, e in found]
        gone = resolve([(r.priority, e - s, s, e) for r, s, e in spans])
        rows = [(r.name, r.label, r.base, s, e, r.weight, g) for (r, s, e), g in zip(spans, gone)]
        names = ("rule", "label", "base", "first_word", "end_word", "weight", "suppressed")
        return len(words), [dict(zip(names, x)) for x in sorted(rows, key=lambda x: (x[3], x[4], x[0]))]

    return scan


def scan_licenses(docs: DataFrame, text: str = "text", out: str = "license") -> DataFrame:
    """Add the struct `out`: n_words, and every detection with its word interval, weight and whether an overlapping
    one of higher priority (or length) contains it.

    A rule runs only on texts that hold all words of one of its gates. Null and empty texts have no words and no detections;
    texts are scanned whole; repeated rows are scanned each by itself; an empty table stays empty; other columns pass
    through untouched, one named like `out` is replaced.
    """
    return docs.withColumn(out, text_udf(each(_scanner), DETECTIONS)(F.col(text)))
