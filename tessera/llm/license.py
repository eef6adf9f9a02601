"""License scans by DataFrame functions alone: ordered signature rules, keyword gates, priorities, interval containment.

Texts are lower-cased (A-Z) and reduced to their words, parted by single spaces. Rules are hand-written notices, and hand-written
forms around hand-written names; each has keywords, words that every match of it holds. One pass finds which keywords a text
has; a rule's expression, a constant of the plan, runs where all of its own are there. A rule's detections are intervals of this string; a detection inside another one of no lower priority is suppressed, in one
ordered pass that holds the furthest end for each priority.
Contract of `scan_licenses`: one row per input row; null and empty texts have no words and no detections; repeated rows
repeat; ties (equal intervals and priorities) leave the rule that comes first; very long texts are read whole, places count
words whatever letters they have; an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# License names as patterns over words, with a keyword that every match holds, and a label.
NAMES = (
    ("mit", "mit", "(?:the )?mit"),
    ("apache-2", "apache", "(?:the )?apache(?: license)?(?: version)? v?2(?: 0)?"),
    ("apache-1.1", "apache", "(?:the )?apache(?: software)?(?: license)?(?: version)? 1 1"),
    ("gpl-3", "general public license", "(?:the )?(?:gnu )?general public license(?: version| v)? v?3(?: 0)?"),
    ("gpl-3", "gpl", "(?:the )?(?:gnu )?gpl(?: version| v)? v?3(?: 0)?"),
    ("gpl-3", "gplv3", "(?:the )?(?:gnu )?gplv3(?: 0)?"),
    ("gpl-2", "general public license", "(?:the )?(?:gnu )?general public license(?: version| v)? v?2(?: 0)?"),
    ("gpl-2", "gpl", "(?:the )?(?:gnu )?gpl(?: version| v)? v?2(?: 0)?"),
    ("gpl-2", "gplv2", "(?:the )?(?:gnu )?gplv2(?: 0)?"),
    ("gpl", "general public", "(?:the )?gnu general public license"),
    ("lgpl-3", "lesser general", "(?:the )?(?:gnu )?lesser general public license(?: version| v)? v?3(?: 0)?"),
    ("lgpl-3", "lgpl", "(?:the )?(?:gnu )?lgpl(?: version| v)? v?3(?: 0)?"),
    ("lgpl-3", "lgplv3", "(?:the )?(?:gnu )?lgplv3(?: 0)?"),
    ("lgpl-2.1", "lesser general", "(?:the )?(?:gnu )?lesser general public license(?: version| v)? v?2 1"),
    ("lgpl-2.1", "lgpl", "(?:the )?(?:gnu )?lgpl(?: version| v)? v?2 1"),
    ("lgpl-2.1", "lgplv2", "(?:the )?(?:gnu )?lgplv2 1"),
    ("agpl-3", "affero general", "(?:the )?(?:gnu )?affero general public license(?: version| v)? v?3(?: 0)?"),
    ("agpl-3", "agpl", "(?:the )?(?:gnu )?agpl(?: version| v)? v?3(?: 0)?"),
    ("agpl-3", "agplv3", "(?:the )?(?:gnu )?agplv3(?: 0)?"),
    ("mpl-2", "mozilla public", "(?:the )?mozilla public license(?: version| v)? v?2(?: 0)?"),
    ("mpl-2", "mpl", "(?:the )?mpl(?: version| v)? v?2(?: 0)?"),
    ("mpl-2", "mplv2", "(?:the )?mplv2(?: 0)?"),
    ("mpl-1.1", "mozilla public", "(?:the )?mozilla public license(?: version| v)? v?1 1"),
    ("mpl-1.1", "mpl", "(?:the )?mpl(?: version| v)? v?1 1"),
    ("bsd-2-clause", "bsd", "(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd)"),
    ("bsd-3-clause", "bsd", "(?:the )?(?:new bsd|modified bsd|bsd 3 clause|3 clause bsd)"),
    ("bsd", "bsd", "(?:the |a )?bsd(?: style)?"),
    ("isc", "isc", "(?:the )?isc"),
    ("zlib", "zlib", "(?:the )?zlib(?: libpng)?"),
    ("boost-1", "boost software", "(?:the )?boost software(?: license)?(?: version)?(?: 1(?: 0)?)?"),
    ("epl-2", "eclipse public", "(?:the )?eclipse public license(?: version| v)? 2(?: 0)?"),
    ("epl-1", "eclipse public", "(?:the )?eclipse public license(?: version| v)? 1(?: 0)?"),
    ("artistic-2", "artistic license", "(?:the )?artistic license(?: version)? 2(?: 0)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by nc nd", "cc by nc nd(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "cc by nc sa", "cc by nc sa(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "cc by nc", "cc by nc(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "cc by nd", "cc by nd(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "cc by sa", "cc by sa(?: [1-4](?: [05])?)?"),
    ("cc-by", "cc by", "cc by(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4](?: [05])?)?(?: international)?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4](?: [05])?)?(?: international)?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4](?: [05])?)?(?: international)?"),
    ("unlicense", "unlicense", "(?:the )?unlicense"),
    ("wtfpl", "wtfpl", "(?:the )?wtfpl(?: version| v)?(?: 2)?"),
    ("public-domain", "public domain", "(?:the )?public domain"),
    ("python-2", "psf", "(?:the )?psf(?: license)?(?: version)?(?: 2)?"),
    ("python-2", "python software", "(?:the )?python software foundation(?: license)?(?: version)?(?: 2)?"),
    ("proprietary", "proprietary", "(?:a )?proprietary"),
)
# How a license is stated around its name, with a keyword; priority 4 is the surest.
FORMS = (
    (4, "under", "(?:this (?:work|software|file|document|project) is )?(?:dual )?licen[cs]ed under (?:the )?(?:terms of )?{}(?: licen[cs]e)?(?: (?:version|v) ?[0-9](?: [0-9])?)?"),
    (4, "under", "(?:released|distributed|published|available|provided) under (?:the )?(?:terms of )?{}(?: licen[cs]e)?"),
    (4, "spdx identifier", "spdx license identifier {}(?: only| or later)?"),
    (3, "subject", "subject to (?:the )?(?:terms of )?(?:the )?{}(?: licen[cs]e)?"),
    (3, "permission granted under", "permission is (?:hereby )?granted under {}(?: licen[cs]e)?"),
    (3, "dedicated", "dedicated to {}"),
    (3, "placed", "placed in {}"),
    (3, "governed", "governed by {}(?: licen[cs]e)?"),
    (2, "license", "{} license"),
    (2, "licence", "{} licence"),
    (2, "license", "(?:see (?:the )?)?license {}"),
    (2, "licence", "(?:see (?:the )?)?licence {}"),
)
# Sentences of license texts and notices, as patterns over words: label, priority, keyword, pattern.
NOTICES = (
    ("mit", 4, "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", 3, "permission notice substantial", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 4, "mit no attribution", "mit no attribution(?: licen[cs]e)?"),
    ("x11", 3, "contained notice", "except as contained in this notice the names? of"),
    ("json", 4, "evil", "the software shall be used for good not evil"),
    ("bsd", 4, "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 3, "redistributions of source", "redistributions of source code must retain the above copyright notice"),
    ("bsd", 3, "redistributions in binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 4, "neither the name", "neither the name of (?:the )?(?:[^ ]+ ){1,8}nor the names of its contributors may be used to endorse or promote products"),
    ("bsd-4-clause", 4, "advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd", 2, "copyright holders and contributors", "this software is provided by the copyright holders and contributors as is"),
    ("bsd-patent", 4, "bsd plus patent", "bsd(?: 2 clause)? plus patent(?: licen[cs]e)?"),
    ("isc", 4, "permission notice appear", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("0bsd", 3, "fee hereby", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", 4, "zero clause bsd", "(?:bsd )?zero clause bsd(?: licen[cs]e)?"),
    ("hpnd", 3, "historical permission notice", "historical permission notice and disclaimer"),
    ("apache-2", 4, "except in compliance with the license", "you may not use this (?:file|software|work|project) except in compliance with the license"),
    ("apache-2", 4, "apache org licenses", "(?:https? )?www apache org licenses license 2 0(?: txt| html)?"),
    ("apache-2", 3, "unless required by applicable law", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2", 3, "licensed to the apache", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 4, "developed by the apache", "this product includes software developed by the apache (?:software foundation|group)"),
    ("gpl-3", 4, "either published general", "gnu general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("gpl-2", 4, "either published general", "gnu general public license as published by the free software foundation either version 2 of the license or(?: at your option)? any later version"),
    ("gpl-2", 4, "published general", "gnu general public license (?:version 2 )?as published by the free software foundation version 2(?: of the license)?"),
    ("gpl", 3, "redistribute modify", "this (?:program|file|library|software) is free software you can redistribute it and or modify it"),
    ("gpl", 2, "hope warranty", "(?:is )?distributed in the hope that it will be useful but without any warranty"),
    ("gpl", 3, "should have received a copy of the gnu", "you should have received a copy of the gnu general public license along with this (?:program|file|library|software)"),
    ("gpl", 2, "software foundation inc", "free software foundation inc (?:51 franklin|59 temple|675 mass)[^ ]*"),
    ("gpl", 3, "verbatim copies", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-3", 4, "gnu licenses gpl", "www gnu org licenses gpl 3 0(?: txt| html| en)?"),
    ("gpl-classpath", 4, "exception permission", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-linking", 3, "exception permission", "as a special exception (?:[^ ]+ ){1,12}permission to link"),
    ("lgpl-2.1", 4, "either published lesser", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license or(?: at your option)? any later version"),
    ("lgpl-3", 4, "lesser general public", "gnu lesser general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("lgpl-2", 4, "library general public", "(?:gnu )?library general public license(?: version 2| v2)?"),
    ("lgpl", 3, "should have received a copy of the gnu lesser", "you should have received a copy of the gnu lesser general public license along with this (?:program|file|library|software)"),
    ("agpl-3", 4, "affero general public", "gnu affero general public license as published by the free software foundation either version 3 of the license or(?: at your option)? any later version"),
    ("agpl-3", 3, "remote network interaction", "remote network interaction use with the gnu general public license"),
    ("gfdl", 4, "free documentation license", "(?:gnu )?free documentation license(?: version 1 [123])?"),
    ("mpl-2", 4, "source code form is subject", "this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-2", 3, "copy of the mpl", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 4, "subject to the mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", 4, "eclipse public", "made available under the terms of the eclipse public license v(?:ersion)? 2 0"),
    ("epl-1", 4, "eclipse public", "made available under the terms of the eclipse public license v(?:ersion)? 1 0"),
    ("cddl-1", 4, "common development and distribution", "common development and distribution license(?: cddl)?(?: version 1 [01]| v1 [01])?"),
    ("cpl-1", 4, "common public license", "common public license(?: version| v) ?1 0"),
    ("ipl-1", 4, "ibm public license", "ibm public license(?: version| v)? 1 0"),
    ("eupl", 4, "european union public", "european union public licen[cs]e(?: v(?:ersion)? 1 [12])?"),
    ("cecill", 4, "cecill", "cecill(?: [bc])?(?: licen[cs]e)?(?: version 2(?: [01])?)?"),
    ("boost-1", 4, "boost software license", "boost software license version 1 0 august 17th 2003"),
    ("boost-1", 4, "boost org license", "www boost org license 1 0 txt"),
    ("zlib", 3, "liable damages", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 4, "plainly marked as such", "altered source versions must be plainly marked as such"),
    ("zlib", 3, "origin misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("libpng-2", 4, "png", "png reference library license version 2"),
    ("unlicense", 4, "free and unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 3, "anyone sell distribute", "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("unlicense", 4, "unlicense org", "(?:https? )?unlicense org"),
    ("wtfpl", 4, "fuck", "do what the fuck you want to public license"),
    ("wtfpl", 3, "fuck", "you just do what the fuck you want to"),
    ("beerware", 4, "beerware", "the beerware license(?: revision 42)?"),
    ("beerware", 3, "whatever retain", "as long as you retain this notice you can do whatever you want with this stuff"),
    ("cc0", 4, "publicdomain zero", "creativecommons org publicdomain zero 1 0"),
    ("cc0", 4, "waived all copyright", "has waived all copyright and related or neighbou?ring rights"),
    ("cc-pdm", 4, "publicdomain mark", "creativecommons org publicdomain mark 1 0"),
    ("cc-by", 4, "org licenses by ", "creativecommons org licenses by [1-4] [05]"),
    ("cc-by-sa", 4, "org licenses by sa ", "creativecommons org licenses by sa [1-4] [05]"),
    ("cc-by-nd", 4, "org licenses by nd ", "creativecommons org licenses by nd [1-4] [05]"),
    ("cc-by-nc", 4, "org licenses by nc ", "creativecommons org licenses by nc [1-4] [05]"),
    ("cc-by-nc-sa", 4, "org licenses by nc sa ", "creativecommons org licenses by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", 4, "org licenses by nc nd ", "creativecommons org licenses by nc nd [1-4] [05]"),
    ("cc-by-nc-sa", 4, "attribution", "attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc-nd", 4, "attribution", "attribution non ?commercial no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?"),
    ("cc-by-nd", 4, "attribution", "attribution no ?deriv(?:s|atives|ative works)(?: [1-4] [05])?"),
    ("artistic-2", 3, "standard version of the package", "you may distribute verbatim copies of the source form of the standard version of the package"),
    ("perl", 4, "perl itself", "(?:under )?the same terms as (?:the )?perl(?: 5)?(?: programming language)?(?: system)? itself"),
    ("ruby", 4, "ruby", "(?:under )?the same (?:terms|license) as ruby|(?:the )?ruby licen[cs]e"),
    ("php-3", 4, "php license", "(?:the )?php license(?: version| v)? 3(?: 0)?(?: 0?1)?"),
    ("python-2", 4, "psf license agreement", "psf license agreement(?: for python)?"),
    ("python-cnri", 4, "cnri", "cnri (?:open source )?license agreement(?: for python)?"),
    ("openssl", 4, "openssl", "this product includes software developed by the openssl project"),
    ("ssleay", 4, "eric young", "cryptographic software written by eric young"),
    ("curl", 4, "curl license", "(?:the )?curl license"),
    ("icu", 4, "icu license", "icu license(?: icu 1 8 1 and later)?"),
    ("unicode", 4, "unicode inc", "unicode inc license agreement data files and software"),
    ("w3c", 4, "w3c software", "w3c software(?: and document)? notice and license"),
    ("ofl-1.1", 4, "open font license", "(?:sil )?open font license(?: version| v)?(?: 1 [01])?"),
    ("ofl-1.1", 3, "reserved font", "with reserved font names?"),
    ("ncsa", 4, "ncsa open source", "(?:university of illinois )?ncsa open source license"),
    ("ms-pl", 4, "microsoft public", "microsoft public license(?: ms pl)?"),
    ("ms-rl", 4, "microsoft reciprocal", "microsoft reciprocal license(?: ms rl)?"),
    ("afl-3", 4, "academic free", "academic free license(?: version| v)? 3 0"),
    ("osl-3", 4, "open software license", "open software license(?: version| v)? 3 0"),
    ("qpl-1", 4, "q public license", "q public license(?: version 1 0)?"),
    ("lppl-1.3", 4, "latex project public", "latex project public license(?: version 1 [0-3][abc]?)?"),
    ("vim", 4, "vim license", "(?:the )?vim license"),
    ("postgresql", 4, "postgresql license", "(?:the )?postgresql license"),
    ("sleepycat", 4, "sleepycat", "(?:the )?sleepycat license"),
    ("upl-1", 4, "universal permissive", "universal permissive license(?: version| v)? 1 0"),
    ("mulan-2", 4, "mulan", "mulan psl v2|mulan permissive software license v(?:ersion)? 2"),
    ("odbl-1", 4, "open database license", "open database license(?: odbl)?(?: v(?:ersion)? 1 0)?"),
    ("odc-by-1", 4, "open data commons", "open data commons attribution license(?: v(?:ersion)? 1 0)?"),
    ("pddl-1", 4, "public domain dedication and", "public domain dedication and licen[cs]e(?: pddl)?(?: v(?:ersion)? 1 0)?"),
    ("cdla", 4, "community data license", "community data license agreement(?: permissive| sharing)?(?: version)?(?: [12] 0)?"),
    ("ogl-3", 4, "open government", "open government licen[cs]e(?: v(?:ersion)? [123] 0)?"),
    ("etalab-2", 4, "licence ouverte", "licence ouverte(?: open licence)?(?: v(?:ersion)? 2 0)?"),
    ("dl-de", 4, "datenlizenz", "datenlizenz deutschland(?: namensnennung| zero)?(?: version 2 0)?"),
    ("openrail", 4, "openrail", "(?:creativeml|bigscience|bigcode) openrail(?: m)?(?: licen[cs]e)?"),
    ("llama", 4, "community license", "llama [234](?: [0-9])? community license(?: agreement)?"),
    ("gemma", 4, "gemma terms", "gemma terms of use"),
    ("sspl-1", 4, "server side public", "server side public license(?: v(?:ersion)? 1)?"),
    ("busl-1.1", 4, "business source", "business source license(?: v(?:ersion)?)? 1 1"),
    ("elastic-2", 4, "elastic license", "elastic license(?: v(?:ersion)?)? 2(?: 0)?"),
    ("commons-clause", 4, "commons clause", "commons clause(?: license)?(?: condition)?(?: v1 0)?"),
    ("polyform", 4, "polyform", "polyform (?:noncommercial|small business|strict|shield|perimeter|free trial|internal use) licen[cs]e"),
    ("confluent", 4, "confluent community", "confluent community license(?: agreement)?(?: version 1 0)?"),
    ("public-domain", 4, "public domain", "(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("public-domain", 3, "public domain", "(?:this (?:work|file|code|text|software) )?is in the public domain"),
    ("public-domain", 3, "copyright restrictions", "no known copyright restrictions"),
    ("us-government", 3, "government", "(?:u s|us|united states) government works?"),
    ("crown", 3, "crown copyright", "crown copyright(?: [12][0-9]{3})?"),
    ("all-rights-reserved", 3, "rights reserved", "(?:all|some) rights reserved"),
    ("all-rights-reserved", 3, "rechte vorbehalten", "alle rechte vorbehalten"),
    ("all-rights-reserved", 3, "tous droits", "tous droits r\u00e9serv\u00e9s"),
    ("all-rights-reserved", 3, "derechos reservados", "todos los derechos reservados"),
    ("copyright", 1, "copyright", "copyright(?: c)?(?: [12][0-9]{3})(?: [12][0-9]{3})?"),
    ("proprietary", 3, "proprietary", "proprietary and confidential"),
    ("proprietary", 4, "unauthorized prohibited", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 3, "publication reproduced", "no part of this publication may be reproduced(?: stored| distributed| or transmitted)?"),
    ("proprietary", 3, "trade", "trade secrets? (?:of|and)"),
    ("proprietary", 2, "internal", "for internal use only"),
    ("proprietary", 2, "distribution", "not for distribution"),
    ("proprietary", 3, "user agreement", "end user licen[cs]e agreement"),
    ("proprietary", 2, "evaluation", "evaluation (?:license|purposes) only"),
    ("non-commercial", 3, "non commercial", "(?:for )?non commercial (?:use|purposes) only"),
    ("non-commercial", 3, "noncommercial", "(?:for )?noncommercial (?:use|purposes) only"),
    ("non-commercial", 3, "commercial", "not (?:be used )?for commercial use"),
    ("research-only", 3, "research", "for (?:academic )?research (?:use|purposes) only"),
    ("personal-use", 2, "personal", "(?:free )?for personal use(?: only)?"),
)


class Rule(NamedTuple):
    label: str
    priority: int
    words: tuple[str, ...]  # that every match holds, a name's or notice's first
    pattern: str


def rules() -> list[Rule]:
    """All rules in order: every form of every name, then the notices."""
    out = [Rule(label, priority, (*name_words.split(), *words.split()), form.replace("{}", name)) for priority, words, form in FORMS for label, name_words, name in NAMES]
    return [*out, *(Rule(label, p, tuple(words.split()), rx) for label, p, words, rx in NOTICES)]


def words_string(text: Column) -> Column:
    """The words, each between two spaces; two spaces if there are none."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def keywords(s: Column) -> Column:
    """Which keywords of rules the text has."""
    every = sorted({w for r in rules() for w in r.words})
    return F.array_intersect(F.array(*map(F.lit, every)), F.split(s, " "))


def gate(present: Column) -> Column:
    """Whether the first keyword of any rule is there."""
    return F.arrays_overlap(present, F.array(*map(F.lit, sorted({r.words[0] for r in rules()}))))


def _found() -> Column:
    """Structs of rule, priority, label and hits, of the rules with hits, of columns s and present; as SQL, which is parsed at once."""
    groups: dict[str, list[str]] = {}
    for k, rule in enumerate(rules()):
        hits = f"regexp_extract_all(s, r'(?<= )(?:{rule.pattern})(?= )', 0)"
        if rest := rule.words[1:]:
            hits = f"CASE WHEN {' AND '.join(f"array_contains(present, '{w}')" for w in rest)} THEN {hits} END"
        groups.setdefault(rule.words[0], []).append(f"named_struct('k', {k}, 'p', {rule.priority}, 'label', '{rule.label}', 'hits', {hits})")
    each = ", ".join(f"CASE WHEN array_contains(present, '{word}') THEN array({', '.join(some)}) END" for word, some in groups.items())
    return F.expr(f"filter(flatten(array_compact(array({each}))), r -> coalesce(size(r.hits), 0) > 0)")


def _detections(s: Column) -> Column:
    """Structs of begin, minus end, minus priority, rule and label, of all rules whose keywords are there; sorted."""

    def placed(r: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,e:int,p:int,k:int,label:string>>").alias("out"))

        def step(acc: Column, hit: Column) -> Column:
            # The next place of the very words, from the last one's end on: an earlier one would have been the hit.
            b = F.call_function("locate", F.concat(F.lit(" "), hit, F.lit(" ")), s, acc["at"] + 1)
            e = b + F.length(hit)
            return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(b.alias("b"), (-e).alias("e"), (-r["p"]).alias("p"), r["k"].alias("k"), r["label"].alias("label")))).alias("out"))

        return F.aggregate(r["hits"], start, step)["out"]

    return F.array_sort(F.flatten(F.transform(_found(), placed)))


def _kept(found: Column) -> Column:
    """One pass over detections in order: what a longer or equal one of no lower priority holds goes. Labels, number, best priority."""
    levels = (1, 2, 3, 4)
    start = F.struct(*(F.lit(0).alias(f"to{p}") for p in levels), F.lit(0).alias("n"), F.lit(0).alias("best"), F.array().cast("array<string>").alias("labels"))

    def step(acc: Column, d: Column) -> Column:
        end, p = -d["e"], -d["p"]
        inside = reduce(lambda a, b: a | b, ((p <= q) & (acc[f"to{q}"] >= end) for q in levels))
        return F.when(inside, acc).otherwise(
            F.struct(
                *(F.when((p == q) & (end > acc[f"to{q}"]), end).otherwise(acc[f"to{q}"]).alias(f"to{q}") for q in levels),
                (acc["n"] + 1).alias("n"), F.greatest(acc["best"], p).alias("best"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"),
            )
        )

    return F.aggregate(found, start, step)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_detections."""
    # The arrays and explodes keep Spark from putting the expression of the string in every place that uses it.
    s, present = F.col("s"), F.col("present")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words_string(F.col("text").cast("string")))).alias("s"))
    d = d.select("doc_id", "s", F.explode(F.array(keywords(s))).alias("present"))
    any_of = "(?<= )(?:" + "|".join(BASE) + ")(?= )"
    based = reduce(lambda a, b: a | b, (F.contains(s, F.lit(f" {x} ")) for x in BASE))
    spaces = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    before = lambda dots: spaces(F.regexp_extract(s, f"(?s)^({dots}){any_of}", 1)) - 1
    d = d.select(
        "doc_id",
        F.when(s == "  ", 0).otherwise(spaces(s) - 1).cast("long").alias("n_words"),
        F.when(based, F.regexp_count(s, F.lit(any_of))).otherwise(0).cast("long").alias("n_base"),
        F.when(based, before(".*?")).cast("long").alias("first_word"),
        F.when(based, before(".*")).cast("long").alias("last_word"),
        F.when(based, F.array_compact(F.array(*(F.when(F.contains(s, F.lit(f" {x} ")), F.lit(y)) for x, y in BASE.items())))).otherwise(F.array().cast("array<string>")).alias("base"),
        F.when(gate(present), _kept(_detections(s))).alias("kept"),
    )
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    none = F.array().cast("array<string>")
    return d.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        joined(F.col("base")).alias("base_labels"),
        joined(F.concat("base", F.coalesce("kept.labels", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce(F.col("kept.best"), F.lit(0)) / 4).cast("double").alias("score"),
        F.coalesce("kept.n", F.lit(0)).cast("long").alias("n_detections"),
    )
