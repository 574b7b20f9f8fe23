"""License scans with ordered signature rules.

A text becomes its words: A-Z lower-cased, every other ASCII character but
letters and digits a separator.  Rules are regular expressions over the words
joined by single blanks.  Most are made of a licence's names, written below by
hand, and of the ways in which texts refer to a licence; others are sentences
of licence texts.  A rule runs only on texts that hold one of its keywords as
a word (the prefilter), and every match of a rule holds one.

Matches are intervals of words.  A match inside another one's interval is
suppressed if that one's priority is at least as high; of equal intervals and
priorities the rule that comes first stays.  Three phrases are searched apart from the rules
and are never suppressed.

Null texts are empty.  Texts are read whole, whatever their length; work grows
with words and matches, as each rule passes over a text once.  Each row is
judged for itself: repeated rows and null identifiers give a row each, extra
columns are ignored, an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import string_buffer

#: The phrases of the contract and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_CONFIDENCE = 0.9

#: label: (keywords, full names, short names or None where they are too common a word).
LICENSES = {
    "mit": ("mit", r"mit(?: expat)? licen[sc]e", r"mit"),
    "mit-0": ("mit", r"mit no attribution(?: licen[sc]e)?", r"mit 0"),
    "x11": ("x11", r"x11 licen[sc]e", r"x11"),
    "apache-2": ("apache", r"apache (?:software )?licen[sc]e(?: version| v)? ?2(?: 0)?|apache licen[sc]e v2(?: 0)?|apache 2(?: 0)? licen[sc]e", r"apache(?: v)? ?2(?: 0)?"),
    "apache-1.1": ("apache", r"apache (?:software )?licen[sc]e(?: version| v)? 1 1", r"apache 1 1"),
    "apache-1.0": ("apache", r"apache (?:software )?licen[sc]e(?: version| v)? 1 0", r"apache 1 0"),
    "apache": ("apache", r"apache (?:software )?licen[sc]e", None),
    "gpl-1": ("general gpl gplv1", r"gnu general public licen[sc]e(?: version| v)? ?1(?: 0)?", r"gpl ?v?1(?: 0)?(?: only| or later)?"),
    "gpl-2": ("general gpl gplv2", r"gnu general public licen[sc]e(?: version| v)? ?2(?: 0)?|gnu gpl ?v?2", r"gpl(?: version)? ?v?2(?: 0)?(?: only| or later)?"),
    "gpl-3": ("general gpl gplv3", r"gnu general public licen[sc]e(?: version| v)? ?3(?: 0)?|gnu gpl ?v?3", r"gpl(?: version)? ?v?3(?: 0)?(?: only| or later)?"),
    "gpl": ("general gpl", r"gnu general public licen[sc]e|gnu gpl", r"gpl"),
    "lgpl-2": ("library lgpl lgplv2", r"gnu library general public licen[sc]e(?: version| v)? ?2(?: 0)?", r"lgpl ?v?2(?: 0)?(?: only| or later)?"),
    "lgpl-2.1": ("lesser lgpl lgplv2", r"gnu lesser general public licen[sc]e(?: version| v)? ?2 1", r"lgpl ?v?2 1(?: only| or later)?"),
    "lgpl-3": ("lesser lgpl lgplv3", r"gnu lesser general public licen[sc]e(?: version| v)? ?3(?: 0)?", r"lgpl ?v?3(?: 0)?(?: only| or later)?"),
    "lgpl": ("lesser library lgpl", r"gnu (?:lesser|library) general public licen[sc]e|gnu lgpl", r"lgpl"),
    "agpl-3": ("affero agpl agplv3", r"gnu affero general public licen[sc]e(?: version| v)? ?3(?: 0)?|affero gpl v?3", r"agpl ?v?3(?: 0)?(?: only| or later)?"),
    "agpl": ("affero agpl", r"(?:gnu )?affero general public licen[sc]e", r"agpl"),
    "gfdl": ("documentation gfdl", r"gnu free documentation licen[sc]e(?: version| v)?(?: 1 [123])?", r"gfdl(?: 1 [123])?(?: only| or later)?"),
    "mpl-1.0": ("mozilla mpl", r"mozilla public licen[sc]e(?: version| v)? ?1 0", r"mpl(?: v)? ?1 0"),
    "mpl-1.1": ("mozilla mpl", r"mozilla public licen[sc]e(?: version| v)? ?1 1", r"mpl(?: v)? ?1 1"),
    "mpl-2": ("mozilla mpl", r"mozilla public licen[sc]e(?: version| v)? ?2(?: 0)?", r"mpl(?: v)? ?2(?: 0)?"),
    "mpl": ("mozilla", r"mozilla public licen[sc]e", None),
    "epl-1": ("eclipse epl", r"eclipse public licen[sc]e(?: version| v)? ?1(?: 0)?", r"epl(?: v)? ?1(?: 0)?"),
    "epl-2": ("eclipse epl", r"eclipse public licen[sc]e(?: version| v)? ?2(?: 0)?", r"epl(?: v)? ?2(?: 0)?"),
    "edl": ("eclipse", r"eclipse distribution licen[sc]e(?: version| v)?(?: 1 0)?", None),
    "cddl": ("cddl distribution", r"common development and distribution licen[sc]e(?: version| v)?(?: 1 [01])?", r"cddl(?: 1 [01])?"),
    "cpl": ("common cpl", r"common public licen[sc]e(?: version| v)?(?: 1 0)?", r"cpl 1 0"),
    "ibm-pl": ("ibm ipl", r"ibm public licen[sc]e(?: version| v)?(?: 1 0)?", r"ipl 1 0"),
    "eupl": ("european eupl", r"european union public licen[sc]e(?: version| v)?(?: 1 [012])?", r"eupl(?: v)?(?: 1 [012])?"),
    "cecill": ("cecill", r"cecill(?: [bc])?(?: free software)? licen[sc]e", r"cecill(?: [bc12](?: [01])?)?"),
    "bsd-0": ("bsd 0bsd", r"(?:zero clause bsd|bsd zero clause|0 clause bsd) licen[sc]e", r"0bsd|bsd 0 clause"),
    "bsd-2": ("bsd freebsd", r"(?:2 clause bsd|bsd 2 clause|simplified bsd|two clause bsd|freebsd) licen[sc]e", r"bsd 2 clause|2 clause bsd"),
    "bsd-3": ("bsd", r"(?:3 clause bsd|bsd 3 clause|modified bsd|new bsd|revised bsd|three clause bsd) licen[sc]e", r"bsd 3 clause|3 clause bsd"),
    "bsd-4": ("bsd", r"(?:4 clause bsd|bsd 4 clause|original bsd|four clause bsd) licen[sc]e", r"bsd 4 clause|4 clause bsd"),
    "bsd": ("bsd", r"bsd(?: style)? licen[sc]e", r"bsd"),
    "isc": ("isc", r"isc licen[sc]e", r"isc"),
    "zlib": ("zlib", r"zlib(?: libpng)? licen[sc]e", r"zlib"),
    "libpng": ("libpng", r"libpng licen[sc]e(?: version)?(?: 2)?", r"libpng(?: 2 0)?"),
    "boost": ("boost bsl", r"boost software licen[sc]e(?: version| v)?(?: 1 0)?", r"bsl 1 0"),
    "unlicense": ("unlicense", r"the unlicense", r"unlicense"),
    "wtfpl": ("wtfpl", r"wtfpl(?: licen[sc]e)?(?: version)?(?: 2)?", r"wtfpl"),
    "artistic-1": ("artistic", r"artistic licen[sc]e(?: version| v)? ?1(?: 0)?", r"artistic 1 0(?: perl)?"),
    "artistic-2": ("artistic", r"artistic licen[sc]e(?: version| v)? ?2(?: 0)?", r"artistic 2 0"),
    "artistic": ("artistic", r"artistic licen[sc]e", None),
    "python": ("python psf", r"(?:python software foundation|psf) licen[sc]e(?: agreement)?(?: version)?(?: 2)?", r"psf 2 0|python 2 0"),
    "ruby": ("ruby", r"ruby licen[sc]e", None),
    "php": ("php", r"php licen[sc]e(?: version| v)?(?: 3 01?)?", r"php 3 01?"),
    "vim": ("vim", r"vim licen[sc]e", None),
    "zpl": ("zope zpl", r"zope public licen[sc]e(?: version| v)?(?: 2 [01])?", r"zpl(?: 2 [01])?"),
    "ncsa": ("ncsa", r"university of illinois ncsa open source licen[sc]e|ncsa(?: open source)? licen[sc]e", r"ncsa"),
    "postgresql": ("postgresql", r"postgresql licen[sc]e", None),
    "openssl": ("openssl", r"openssl licen[sc]e", None),
    "w3c": ("w3c", r"w3c(?: software)?(?: notice and)? licen[sc]e", None),
    "unicode": ("unicode", r"unicode licen[sc]e(?: agreement)?(?: v3)?", r"unicode dfs 201[56]"),
    "afl-3": ("academic afl", r"academic free licen[sc]e(?: version| v)?(?: 3 0)?", r"afl(?: 3 0)?"),
    "osl-3": ("osl open", r"open software licen[sc]e(?: version| v)?(?: 3 0)?", r"osl(?: 3 0)?"),
    "qpl": ("qpl", r"q public licen[sc]e qpl", r"qpl(?: 1 0)?"),
    "apsl": ("apple apsl", r"apple public source licen[sc]e(?: version)?(?: 2 0)?", r"apsl(?: 2 0)?"),
    "ms-pl": ("microsoft ms", r"microsoft public licen[sc]e", r"ms pl"),
    "ms-rl": ("microsoft ms", r"microsoft reciprocal licen[sc]e", r"ms rl"),
    "ofl": ("sil ofl", r"sil open font licen[sc]e(?: version)?(?: 1 [01])?", r"ofl(?: 1 [01])?"),
    "odbl": ("database odbl", r"open (?:data commons open )?database licen[sc]e(?: version| v)?(?: 1 0)?", r"odbl(?: 1 0)?"),
    "odc-by": ("commons odc", r"open data commons attribution licen[sc]e(?: version| v)?(?: 1 0)?", r"odc by(?: 1 0)?"),
    "pddl": ("commons pddl", r"open data commons public domain dedication and licen[sc]e", r"pddl(?: 1 0)?"),
    "cc0": ("cc0 creative", r"creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", r"cc0(?: 1 0)?"),
    "cc-by": ("cc creative", r"creative commons attribution(?: (?:[234] [05]))?(?: international| unported| generic)?(?: public)? licen[sc]e", r"cc by(?: [1234] [05])?"),
    "cc-by-sa": ("cc creative", r"creative commons attribution share ?alike(?: (?:[234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", r"cc by sa(?: [1234] [05])?"),
    "cc-by-nd": ("cc creative", r"creative commons attribution no ?derivatives(?: works)?(?: (?:[234] [05]))?(?: international| unported)?(?: public)?(?: licen[sc]e)?", r"cc by nd(?: [1234] [05])?"),
    "cc-by-nc": ("cc creative", r"creative commons attribution non ?commercial(?: (?:[234] [05]))?(?: international| unported| generic)?(?: public)?(?: licen[sc]e)?", r"cc by nc(?: [1234] [05])?"),
    "cc-by-nc-sa": ("cc creative", r"creative commons attribution non ?commercial share ?alike(?: (?:[234] [05]))?(?: international| unported)?(?: public)?(?: licen[sc]e)?", r"cc by nc sa(?: [1234] [05])?"),
    "cc-by-nc-nd": ("cc creative", r"creative commons attribution non ?commercial no ?derivatives(?: (?:[234] [05]))?(?: international| unported)?(?: public)?(?: licen[sc]e)?", r"cc by nc nd(?: [1234] [05])?"),
    "busl": ("business busl", r"business source licen[sc]e(?: version| v)?(?: 1 1)?", r"busl(?: 1 1)?"),
    "sspl": ("server sspl", r"server side public licen[sc]e(?: version| v)?(?: 1)?", r"sspl(?: 1 0)?"),
    "elastic-2": ("elastic", r"elastic licen[sc]e(?: version| v)? ?2(?: 0)?", r"elastic 2 0"),
    "polyform-nc": ("polyform", r"polyform noncommercial licen[sc]e(?: 1 0 0)?", r"polyform noncommercial(?: 1 0 0)?"),
    "openrail": ("openrail openrailm rail railm", r"(?:creativeml )?open ?rail ?m?(?: licen[sc]e)?", r"openrail(?: m)?"),
    "json": ("json", r"json licen[sc]e", None),
    "beerware": ("beerware beer", r"(?:the )?beer ?ware licen[sc]e", r"beerware"),
    "nasa": ("nasa", r"nasa open source agreement(?: version)?(?: 1 3)?", r"nasa 1 3"),
}

#: Ways of referring to a licence: name, priority, confidence, pattern over N (full or short name), L (full name) and S (short name).
REFERENCES = (
    ("tag", 5, 1.0, r"spdx licen[sc]e identifier S"),
    ("grant", 4, 0.95, r"(?:licensed|released|distributed|redistributed|published|available|provided|offered|covered|shared) (?:to you )?(?:under|with|by|subject to) (?:the )?(?:terms (?:and conditions )?of )?(?:either )?(?:the |an? )?N"),
    ("permitted", 4, 0.95, r"(?:use|copy|modify|redistribute|distribute)(?: it)? (?:it )?(?:under|according to) the terms of the N"),
    ("romance", 3, 0.85, r"(?:(?:sous|sous la|selon la) licence|(?:bajo|bajo la|con) licencia) (?:N)|(?:unter|gemass) (?:der )?S lizenz"),
    ("field", 3, 0.85, r"licen[sc]e (?:is |type |name )?S"),
    ("name", 2, 0.8, r"L"),
    ("mention", 1, 0.5, r"S (?:licen[sc]ed?|lizenz)"),
)

#: Sentences of licence texts: (label, keywords, pattern).
SENTENCES = (
    ("mit", "hereby", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "fee", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", "endorse", r"neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "redistribute", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e"),
    ("lgpl", "redistribute", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e"),
    ("gpl", "verbatim", r"everyone is permitted to copy and distribute verbatim copies of this license document"),
    ("agpl", "remotely", r"all users interacting with it remotely through a computer network"),
    ("gfdl", "invariant", r"with no invariant sections no front cover texts and no back cover texts"),
    ("apache-2", "apache", r"you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0"),
    ("mpl-2", "mozilla", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("zlib", "misrepresented", r"the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "organization", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "you", r"you just do what the f[^ ]{3} you want to"),
    ("cc0", "waived", r"the person who associated a work with this deed has dedicated the work to the public domain by waived all"),
    ("cc-by", "creativecommons", r"creativecommons org licenses by(?: [1234] [05])?"),
    ("cc-by-sa", "creativecommons", r"creativecommons org licenses by sa(?: [1234] [05])?"),
    ("cc-by-nc", "creativecommons", r"creativecommons org licenses by nc(?: [1234] [05])?"),
    ("cc-by-nd", "creativecommons", r"creativecommons org licenses by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "creativecommons", r"creativecommons org licenses by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "creativecommons", r"creativecommons org licenses by nc nd(?: [1234] [05])?"),
    ("cc0", "creativecommons", r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("ofl", "font", r"this font software is licensed under the sil open font licen[sc]e"),
    ("json", "evil", r"the software shall be used for good not evil"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("all-rights-reserved", "reserved", r"all rights reserved"),
    ("proprietary", "proprietary", r"(?:proprietary and confidential|confidential and proprietary)|proprietary licen[sc]e"),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|reproduction|distribution) (?:of this (?:file|document|work|software) )?(?:is )?(?:strictly )?prohibited"),
)


@dataclass(frozen=True)
class Rule:
    """``keywords``: words of which every match holds one; without any, the rule runs on every text."""

    name: str
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: str


def _forms(keywords: str) -> tuple[str, ...]:
    """The keywords of a licence, and each with a version written onto it, as in ``gplv3``."""
    return tuple(k + v for k in keywords.split() for v in ("", "1", "2", "3", "v1", "v2", "v3"))


def default_rules() -> tuple[Rule, ...]:
    """All rules in their order: licences as listed, each with its references, then the sentences."""
    rules = []
    for label, (keywords, full, short) in LICENSES.items():
        names = {"N": f"(?:{full}|{short})" if short else f"(?:{full})", "L": f"(?:{full})", "S": short and f"(?:{short})"}
        for name, priority, confidence, pattern in REFERENCES:
            if "S" in pattern and not short:
                continue
            rules.append(Rule(f"{label}/{name}", label, priority, confidence, _forms(keywords), re.sub("[NLS]", lambda m, names=names: names[m[0]], pattern)))
    rules += [Rule(f"{label}/sentence-{k}", label, 4, 0.9, tuple(keywords.split()), pattern) for k, (label, keywords, pattern) in enumerate(SENTENCES)]
    return tuple(rules)


#: Every byte to what it is in a word, separators to a blank.
_WORD_BYTES = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


class Scanner:
    """Compiled rules behind their keywords."""

    def __init__(self, rules: Iterable[Rule]):
        self.rules = tuple(rules)
        # A match starts after a blank and ends before one, so that it covers whole words.
        self.compiled = [re.compile(f" (?:{r.pattern})(?= )".encode()) for r in self.rules]
        self.gates: dict[bytes, list[int]] = {}
        self.open = [k for k, r in enumerate(self.rules) if not r.keywords]
        for k, r in enumerate(self.rules):
            for word in r.keywords:
                self.gates.setdefault(word.encode(), []).append(k)
        self.base = [(f" {phrase} ".encode(), label) for phrase, label in BASE]
        self.keywords = frozenset(self.gates) | {max(phrase.split(), key=len).encode() for phrase, _ in BASE}
        self.top = max((r.priority for r in self.rules), default=0)

    def scan(self, text: bytes):
        """Number of words, places of the phrases ``(label, first word)``, and matches ``(rule, first word, end word)`` that nothing suppresses, by place."""
        words = text.translate(_WORD_BYTES).split()
        held = self.keywords.intersection(words)
        if not held and not self.open:
            return len(words), [], []
        joined = b" " + b" ".join(words) + b" "
        places, found = [], []
        for phrase, label in self.base:
            at = joined.find(phrase)
            while at >= 0:
                places.append((label, at))
                at = joined.find(phrase, at + 1)
        for k in sorted({k for word in held for k in self.gates.get(word, ())} | set(self.open)):
            found += [(k, m.start(), m.end()) for m in self.compiled[k].finditer(joined)]
        if not places and not found:
            return len(words), [], []
        blanks = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        word = lambda at: int(np.searchsorted(blanks, at))
        return len(words), sorted(((label, word(at)) for label, at in places), key=lambda x: (x[1], x[0])), self.resolve([(k, word(a), word(b)) for k, a, b in found])

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The matches that lie in no other match of the same or a higher priority."""
        reached, kept = [-1] * (self.top + 1), []
        for k, start, stop in sorted(found, key=lambda x: (x[1], -x[2], -self.rules[x[0]].priority, x[0])):
            priority = self.rules[k].priority
            # What came before starts here or earlier, so it holds this match if it reaches as far.
            if max(reached[priority:]) < stop:
                kept.append((k, start, stop))
            reached[priority] = max(reached[priority], stop)
        return kept


DETECTED = (
    "doc_id long, n_words long, phrases array<struct<label: string, first_word: long>>,"
    " matches array<struct<label: string, rule: string, priority: int, first_word: long, end_word: long>>, score double"
)
_PHRASES = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())]))
_MATCHES = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("priority", pa.int32()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("phrases", _PHRASES), ("matches", _MATCHES), ("score", pa.float64())])


def score(confidences: dict[str, float]) -> float:
    """How sure it is that a text names a licence, from its labels' best confidences, as if they were independent."""
    doubt = 1.0
    for label in sorted(confidences):
        doubt *= 1.0 - confidences[label]
    return 1.0 - doubt


def detect(docs: DataFrame, rules: Iterable[Rule] | None = None) -> DataFrame:
    """Per row of ``docs (doc_id, text)`` its number of words, the places of the phrases, the matches with their spans of words, and a score from 0 to 1."""
    chosen = default_rules() if rules is None else tuple(rules)

    def run(batches):
        scanner = Scanner(chosen)
        for batch in batches:
            raw, offsets = string_buffer(batch.column(1))
            ends, columns = offsets.tolist(), [[], [], [], []]
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                n, places, found = scanner.scan(raw[a:b].tobytes())
                sure = {label: BASE_CONFIDENCE for label, _ in places}
                for k, _, _ in found:
                    r = scanner.rules[k]
                    sure[r.label] = max(sure.get(r.label, 0.0), r.confidence)
                columns[0].append(n)
                columns[1].append([{"label": label, "first_word": at} for label, at in places])
                columns[2].append([{"label": (r := scanner.rules[k]).label, "rule": r.name, "priority": r.priority, "first_word": s, "end_word": e} for k, s, e in found])
                columns[3].append(score(sure))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW)[1:], strict=True))], schema=_ARROW)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, DETECTED)


def joined_labels(*arrays: Column) -> Column:
    """The different labels of arrays of structs, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(a, lambda x: x["label"]) for a in arrays]))), ",")


def summary(detected: DataFrame) -> DataFrame:
    """One line a document: counts, first and last place of a phrase, and labels."""
    at = F.transform("phrases", lambda x: x["first_word"])
    return detected.select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        joined_labels(F.col("phrases")).alias("base_labels"), joined_labels(F.col("phrases"), F.col("matches")).alias("labels"), "score", F.size("matches").cast("long").alias("n_matches"),
    )
