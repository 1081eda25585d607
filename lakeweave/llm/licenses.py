"""License scan with ordered signature rules, in DataFrame expressions only.

A cheap keyword condition picks the texts worth reading. Those are reduced to words joined
by single blanks, and each rule whose own keyword occurs there is matched. Detections are
intervals of word numbers; one that lies inside another of higher priority is suppressed,
and so is the shorter or later of two with equal priority.

Defined results: null text counts as empty; a text without detections has empty labels, null
first_word and last_word and score 0; rows are independent; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, places, table

#: A word, before lowering A-Z.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases that always count, with their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: What a text must hold for any rule to match, in either case.
GATE = rf"(?i)licen[cs]|buy{BETWEEN}+me{BETWEEN}+a{BETWEEN}+beer|font{BETWEEN}+software|source{BETWEEN}+agreement|mulan|without{BETWEEN}+permission|proprietary|includes{BETWEEN}+software{BETWEEN}+developed|altered{BETWEEN}+source|png{BETWEEN}+reference|advertising{BETWEEN}+materials|endorse{BETWEEN}+or{BETWEEN}+promote|mozilla{BETWEEN}+org{BETWEEN}+mpl|(?<![0-9a-z])cc(?:0|{BETWEEN}+(?:by|zero|0))|gpl|bsd|creative{BETWEEN}+commons|apache{BETWEEN}+2|mit{BETWEEN}+no{BETWEEN}+attribution|spdx|copyright|copyleft|public{BETWEEN}+domain|rights{BETWEEN}+reserved|hereby|warrant|redistribut|perpetual|trademark"

#: (label, keyword, names as patterns over words joined by blanks). Most specific first within a family.
#: Every match of a name holds the keyword; a name whose matches need not has one of its own: (name, keyword).
FAMILIES = [
    ("agpl-3", "affero", [r"gnu affero general public licen[cs]e(?: version| v)? ?3", (r"agpl ?v?3(?: 0)?", "agpl")]),
    ("agpl", "affero", [r"(?:gnu )?affero general public licen[cs]e", (r"gnu agpl", "agpl")]),
    ("lgpl-2.1", "lesser", [r"gnu lesser general public licen[cs]e(?: version| v)? ?2 1", (r"lgpl ?v?2 1", "lgpl")]),
    ("lgpl-3", "lesser", [r"gnu lesser general public licen[cs]e(?: version| v)? ?3", (r"lgpl ?v?3(?: 0)?", "lgpl")]),
    ("lgpl-2", "library general", [r"gnu library general public licen[cs]e(?: version| v)? ?2"]),
    ("lgpl", "lesser", [r"(?:gnu )?lesser general public licen[cs]e"]),
    ("gpl-2", "general public", [r"gnu general public licen[cs]e(?: version| v)? ?2(?: 0)?", (r"gpl ?v?2(?: 0)?", "gpl")]),
    ("gpl-3", "general public", [r"gnu general public licen[cs]e(?: version| v)? ?3(?: 0)?", (r"gpl ?v?3(?: 0)?", "gpl")]),
    ("gpl", "general public", [r"(?:gnu )?general public licen[cs]e", (r"gnu gpl", "gpl")]),
    ("gfdl-1.3", "free documentation", [r"gnu free documentation licen[cs]e(?: version| v)? ?1 3"]),
    ("gfdl", "free documentation", [r"(?:gnu )?free documentation licen[cs]e"]),
    ("apache-2", "apache", [r"apache(?: software)? licen[cs]e(?: version| v)? ?2(?: 0)?", r"apache 2(?: 0)?"]),
    ("apache-1.1", "apache", [r"apache(?: software)? licen[cs]e(?: version| v)? ?1 1"]),
    ("apache", "apache", [r"apache(?: software)? licen[cs]e"]),
    ("mit-0", "mit", [r"mit no attribution", r"mit 0 licen[cs]e"]),
    ("mit", "mit", [r"mit licen[cs]e", r"mit x11 licen[cs]e", (r"expat licen[cs]e", "expat")]),
    ("bsd-2", "bsd", [r"(?:simplified |freebsd )bsd licen[cs]e", r"bsd 2 clause(?: licen[cs]e)?", r"2 clause bsd(?: licen[cs]e)?"]),
    ("bsd-3", "bsd", [r"(?:new |modified |revised )bsd licen[cs]e", r"bsd 3 clause(?: licen[cs]e)?", r"3 clause bsd(?: licen[cs]e)?"]),
    ("bsd-4", "bsd", [r"original bsd licen[cs]e", r"bsd 4 clause(?: licen[cs]e)?"]),
    ("0bsd", "bsd", [r"zero clause bsd(?: licen[cs]e)?", r"0bsd(?: licen[cs]e)?"]),
    ("bsd", "bsd", [r"bsd(?: style)? licen[cs]e"]),
    ("mpl-2", "mozilla", [r"mozilla public licen[cs]e(?: version| v)? ?2(?: 0)?"]),
    ("mpl-1.1", "mozilla", [r"mozilla public licen[cs]e(?: version| v)? ?1 1"]),
    ("mpl", "mozilla", [r"mozilla public licen[cs]e"]),
    ("epl-2", "eclipse", [r"eclipse public licen[cs]e(?: version| v)? ?2(?: 0)?"]),
    ("epl-1", "eclipse", [r"eclipse public licen[cs]e(?: version| v)? ?1(?: 0)?"]),
    ("epl", "eclipse", [r"eclipse public licen[cs]e"]),
    ("eupl-1.2", "european union", [r"european union public licen[cs]e(?: version| v)? ?1 2"]),
    ("eupl", "european union", [r"european union public licen[cs]e"]),
    ("cddl-1", "common development", [r"common development and distribution licen[cs]e(?: version| v)? ?1(?: 0)?"]),
    ("cddl", "common development", [r"common development and distribution licen[cs]e"]),
    ("cpl", "common public", [r"common public licen[cs]e"]),
    ("artistic-2", "artistic", [r"artistic licen[cs]e(?: version| v)? ?2(?: 0)?"]),
    ("artistic", "artistic", [r"artistic licen[cs]e"]),
    ("boost-1", "boost", [r"boost software licen[cs]e(?: version| v)? ?1(?: 0)?"]),
    ("boost", "boost", [r"boost software licen[cs]e"]),
    ("isc", "isc", [r"isc licen[cs]e"]),
    ("zlib", "zlib", [r"zlib(?: libpng)? licen[cs]e"]),
    ("unlicense", "unlicense", [r"the unlicense", r"unlicense licen[cs]e"]),
    ("wtfpl", "what the", [r"do what the f[a-z]+ you want to public licen[cs]e"]),
    ("python-2", "python", [r"python software foundation licen[cs]e(?: version| v)? ?2", (r"psf licen[cs]e", "psf")]),
    ("php-3", "php", [r"php licen[cs]e(?: version| v)? ?3(?: 01| 0)?"]),
    ("ruby", "ruby", [r"ruby licen[cs]e"]),
    ("openssl", "openssl", [r"openssl licen[cs]e"]),
    ("ofl-1.1", "open font", [r"sil open font licen[cs]e(?: version| v)? ?1 1"]),
    ("ofl", "open font", [r"(?:sil )?open font licen[cs]e"]),
    ("odbl", "open database", [r"open (?:data commons open )?database licen[cs]e"]),
    ("ogl", "open government", [r"open government licen[cs]e(?: v| version)?(?: ?[123](?: 0)?)?"]),
    ("ms-pl", "microsoft public", [r"microsoft public licen[cs]e"]),
    ("ms-rl", "microsoft reciprocal", [r"microsoft reciprocal licen[cs]e"]),
    ("upl-1", "universal permissive", [r"universal permissive licen[cs]e(?: version| v)?(?: ?1(?: 0)?)?"]),
    ("busl-1.1", "business source", [r"business source licen[cs]e(?: version| v)?(?: ?1 1)?"]),
    ("sspl-1", "server side", [r"server side public licen[cs]e(?: version| v)?(?: ?1)?"]),
    ("elastic-2", "elastic", [r"elastic licen[cs]e(?: version| v)?(?: ?2(?: 0)?)?"]),
    ("cc-by-nc-nd", "nc", [r"cc by nc nd", (r"creative commons attribution non ?commercial no ?deriv(?:s|atives|ative works)", "creative commons")]),
    ("cc-by-nc-sa", "nc", [r"cc by nc sa", (r"creative commons attribution non ?commercial share ?alike", "creative commons")]),
    ("cc-by-nc", "nc", [r"cc by nc", (r"creative commons attribution non ?commercial", "creative commons")]),
    ("cc-by-nd", "nd", [r"cc by nd", (r"creative commons attribution no ?deriv(?:s|atives|ative works)", "creative commons")]),
    ("cc-by-sa", "sa", [r"cc by sa", (r"creative commons attribution share ?alike", "creative commons")]),
    ("cc-by", "by", [r"cc by", (r"creative commons attribution", "creative commons")]),
    ("cc0", "cc", [r"cc0(?: 1 0)?", r"cc zero", (r"creative commons zero", "creative commons")]),
    ("public-domain", "public domain", [r"public domain dedication", r"in the public domain", r"dedicated to the public domain"]),
    ("proprietary", "rights reserved", [r"all rights reserved"]),
]

#: (label, keyword, sentence as a pattern, score): wording of license texts and notices, each a rule of its own.
SIGNATURES = [
    ("mit", "hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", 1.0),
    ("mit", "substantial portions", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 0.95),
    ("isc", "hereby granted", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice", 1.0),
    ("0bsd", "hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted(?! provided)", 0.95),
    ("hpnd", "hereby granted", "permission to use copy modify and distribute this software and its documentation for any purpose(?: and)? without fee is hereby granted", 0.95),
    ("curl", "hereby granted", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", 0.95),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 1.0),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice", 0.9),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice", 0.9),
    ("bsd-3", "endorse or promote", "neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products", 0.95),
    ("bsd-4", "advertising materials", "all advertising materials mentioning features or use of this software must display", 0.95),
    ("gpl", "free software", "this (?:program|library|file|package) is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", 1.0),
    ("lgpl", "free software", "this (?:program|library|file|package) is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", 1.0),
    ("agpl", "free software", "this (?:program|library|file|package) is free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e", 1.0),
    ("gpl", "general public", "you should have received a copy of the gnu general public licen[cs]e", 0.9),
    ("lgpl", "general public", "you should have received a copy of the gnu (?:lesser|library) general public licen[cs]e", 0.9),
    ("agpl", "general public", "you should have received a copy of the gnu affero general public licen[cs]e", 0.9),
    ("gpl-2-or-later", "version 2", "either version 2 of the licen[cs]e or (?:at your option )?any later version", 0.9),
    ("gpl-3-or-later", "version 3", "either version 3 of the licen[cs]e or (?:at your option )?any later version", 0.9),
    ("gfdl", "free documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e", 1.0),
    ("apache-2", "apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", 1.0),
    ("apache-2", "apache", "http www apache org licenses license 2 0", 0.95),
    ("apache-1.1", "apache", "this product includes software developed by the apache software foundation", 0.9),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0", 1.0),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1", 1.0),
    ("mpl", "mozilla", "(?:http|https) mozilla org mpl 2 0", 0.9),
    ("epl-1", "eclipse", "made available under the terms of the eclipse public license v1 0", 1.0),
    ("epl-2", "eclipse", "made available under the terms of the eclipse public license (?:v )?2 0", 1.0),
    ("cddl", "common development", "the contents of this file are subject to the terms of the common development and distribution license", 1.0),
    ("cpl", "common public", "made available under the terms of the common public license", 1.0),
    ("artistic", "artistic", "you may distribute under the terms of either the gnu general public license or the artistic license", 1.0),
    ("perl", "as perl", "you can redistribute it and or modify it under the same terms as perl", 0.95),
    ("ruby", "as ruby", "you can redistribute it and or modify it under the same terms as ruby", 0.9),
    ("boost-1", "boost", "distributed under the boost software license version 1 0", 1.0),
    ("boost-1", "hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", 1.0),
    ("zlib", "express or implied warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 0.95),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented", 0.95),
    ("libpng", "png reference", "the png reference library is supplied as is", 0.6),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain", 1.0),
    ("wtfpl", "what the", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed .{0,200}?you just do what the", 1.0),
    ("fsf-text", "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", 0.8),
    ("beerware", "beer", "you can do whatever you want with this stuff .{0,80}?buy me a beer in return", 0.95),
    ("python-2", "python software foundation", "python software foundation license version 2", 1.0),
    ("python-2", "psf", "psf is making python available to licensee on an as is basis", 0.9),
    ("php-3", "php", "this source file is subject to version 3 01 of the php license", 1.0),
    ("openssl", "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit", 1.0),
    ("ofl-1.1", "open font", "this font software is licensed under the sil open font license version 1 1", 1.0),
    ("ofl", "font software", "the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself", 0.8),
    ("odbl", "open database", "is made available under the open database license", 1.0),
    ("odc-by", "open data commons", "is made available under the open data commons attribution license", 1.0),
    ("pddl", "public domain dedication", "is made available under the (?:open data commons )?public domain dedication and licen[cs]e", 0.9),
    ("ogl", "open government", "contains public sector information licensed under the open government licen[cs]e", 1.0),
    ("ms-pl", "microsoft public", "this license governs use of the accompanying software .{0,80}?microsoft public license", 0.9),
    ("upl-1", "universal permissive", "the universal permissive license upl version 1 0", 1.0),
    ("busl-1.1", "business source", "the business source license .{0,60}?is not an open source license", 1.0),
    ("sspl-1", "server side", "server side public license version 1", 1.0),
    ("elastic-2", "elastic", "you may not provide the software to third parties as a hosted or managed service .{0,400}?elastic license", 0.9),
    ("commons-clause", "commons clause", "commons clause license condition", 1.0),
    ("polyform-nc", "polyform", "polyform noncommercial license", 1.0),
    ("polyform-sb", "polyform", "polyform small business license", 1.0),
    ("cecill", "cecill", "cecill(?: [abc])? (?:free software )?licen[cs]e", 0.9),
    ("nasa", "nasa open source", "nasa open source agreement(?: version 1 3)?", 0.9),
    ("ipl-1", "ibm public", "ibm public license(?: version 1 0)?", 0.9),
    ("qpl-1", "q public", "(?:the )?q public license(?: version 1 0)?", 0.9),
    ("ncsa", "illinois", "university of illinois(?: ncsa)? open source license", 0.95),
    ("postgresql", "postgresql", "postgresql license", 0.9),
    ("vim", "vim", "vim license", 0.8),
    ("x11", "x11", "x11 license", 0.8),
    ("blueoak-1", "blue oak", "blue oak model license(?: version)? 1 0 0", 1.0),
    ("mulan-2", "mulan", "mulan psl v2", 0.9),
    ("cc-by", "creativecommons org", "creativecommons org licenses by [1-4] [0-9]", 0.95),
    ("cc-by-sa", "creativecommons org", "creativecommons org licenses by sa [1-4] [0-9]", 0.95),
    ("cc-by-nd", "creativecommons org", "creativecommons org licenses by nd [1-4] [0-9]", 0.95),
    ("cc-by-nc", "creativecommons org", "creativecommons org licenses by nc [1-4] [0-9]", 0.95),
    ("cc-by-nc-sa", "creativecommons org", "creativecommons org licenses by nc sa [1-4] [0-9]", 0.95),
    ("cc-by-nc-nd", "creativecommons org", "creativecommons org licenses by nc nd [1-4] [0-9]", 0.95),
    ("cc0", "waived", "to the extent possible under law .{1,120}? has waived all copyright", 1.0),
    ("public-domain", "public domain", "(?:placed|released|put) (?:in|into) the public domain", 0.9),
    ("public-domain", "public domain", "no copyright (?:is )?claimed .{0,40}?public domain", 0.8),
    ("us-government", "united states government", "work of the united states government .{0,120}?public domain", 0.9),
    ("proprietary", "proprietary", "proprietary and confidential .{0,200}?copyright", 0.8),
    ("proprietary", "without permission", "may not be (?:reproduced|copied|distributed|republished) without permission", 0.6),
    ("warranty", "without warranty", "without warranty of any kind express or implied", 0.5),
    ("warranty", "merchantability", "warrant(?:y|ies) of merchantability", 0.5),
]

#: (pattern around a name, priority added, score). The stronger the wording, the higher.
FRAMES = [
    ("spdx licen[cs]e identifier {0}", 40, 1.0),
    ("(?:licen[cs]ed|released|distributed|published|available|provided) under (?:the )?(?:terms of the |terms of )?{0}", 30, 0.95),
    ("(?:subject to|governed by|covered by) (?:the )?(?:terms of the )?{0}", 20, 0.9),
    ("(?:this|the) (?:work|software|file|program|project|document) is (?:licen[cs]ed )?under (?:the )?{0}", 35, 0.95),
    ("{0}", 0, 0.7),
]


def rules() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, pattern, priority, score): sentences, then each family's names in each frame."""
    out = [(label, keyword, f"(?<= ){sentence}(?= )", 50 * 1000 + 1000 - at, score) for at, (label, keyword, sentence, score) in enumerate(SIGNATURES)]
    for at, (label, keyword, names) in enumerate(FAMILIES):
        for name, own in (x if isinstance(x, tuple) else (x, keyword) for x in names):
            for frame, priority, score in FRAMES:
                out.append((label, own, f"(?<= ){frame.format(f'(?:{name})')}(?= )", priority * 1000 + 1000 - at, score))
    return out


def normalised(text: Column) -> Column:
    """Words joined by blanks, with a blank at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), rf"(?:[\x00-\x2F\x3A-\x60\x7B-\x7F])+", " ")), F.lit(" "))


def _hits(words: Column, pattern: Column) -> Column:
    """Intervals (first word, end word) of a pattern's matches; they begin after and end before a blank."""
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    show = lambda start, end: F.concat((start - 1).cast("string"), F.lit(":"), end.cast("string"))
    listed = places(words, pattern, blanks, lambda _: F.lit(True), show)
    return F.transform(
        F.filter(F.split(listed, ","), lambda s: F.length(s) > 0),
        lambda s: F.struct(F.get(F.split(s, ":"), F.lit(0)).cast("int").alias("start"), F.get(F.split(s, ":"), F.lit(1)).cast("int").alias("end")),
    )


def _constant(rows: list[tuple], names: str) -> Column:
    """An array of structs as one folded constant."""
    import json

    keys = [n.split()[0] for n in names.split(", ")]
    return F.from_json(F.lit(json.dumps([dict(zip(keys, r, strict=True)) for r in rows])), f"array<struct<{names.replace(' ', ':')}>>".replace(",:", ","))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, base (label, start, end), found (detections left after suppression)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"), F.when(text.rlike(GATE), normalised(text)).alias("words"))
    words = F.col("words")

    def places(phrase: str, label: str) -> Column:
        return F.transform(_hits(words, F.lit(f"(?<= ){phrase}(?= )")), lambda h: F.struct(F.lit(label).alias("label"), h["start"].alias("start"), h["end"].alias("end")))

    base = F.concat(*[places(*b) for b in BASE])
    every = _constant(rules(), "label string, keyword string, pattern string, priority int, score double")
    usable = F.filter(every, lambda r: F.contains(words, r["keyword"]))
    detected = F.array_distinct(F.flatten(F.transform(usable, lambda r: F.transform(
        _hits(words, r["pattern"]),
        lambda h: F.struct(r["priority"].alias("priority"), h["start"].alias("start"), h["end"].alias("end"), r["label"].alias("label"), r["score"].alias("score")),
    ))))
    none = "array<struct<label:string,start:int,end:int>>"
    d = d.select("doc_id", "n_words", F.when(words.isNotNull(), base).otherwise(F.array().cast(none)).alias("base"), F.when(words.isNotNull(), detected).alias("detected"))

    def beaten(x, y):
        inside = (y["start"] <= x["start"]) & (y["end"] >= x["end"])
        longer = (y["end"] - y["start"]) > (x["end"] - x["start"])
        return inside & ((y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & longer))

    kept = F.filter("detected", lambda x: ~F.exists("detected", lambda y: beaten(x, y)))
    return d.select("doc_id", "n_words", "base", F.coalesce(kept, F.filter("detected", lambda _: F.lit(False))).alias("found"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    labels = lambda *of: F.array_join(F.array_sort(F.array_distinct(F.concat(*[F.transform(c, lambda x: x["label"]) for c in of]))), ",")
    some = F.coalesce("found", F.array().cast("array<struct<priority:int,start:int,end:int,label:string,score:double>>"))
    starts = F.transform("base", lambda b: b["start"].cast("long"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(F.col("base")).alias("base_labels"),
        labels(F.col("base"), some).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform(some, lambda x: x["score"])), F.lit(0.0))).alias("score"),
    )
