"""License scans: ordered signature rules behind a keyword prefilter.

Signatures are names, full, short and as SPDX identifiers, in sentences that speak of a license,
and phrases of the headers and bodies of the licenses themselves.

A text is reduced to its words between single spaces. A text without any gate word is done. Of
the others, a signature is tried only if its keyword occurs. Signatures are regexes over whole
words; each has a priority, 0 the highest. A detection that lies inside another one of the same
or a higher priority is suppressed, so ``gnu lesser general public license`` does not also count
as the license whose name it contains. One pass over the sorted detections decides that: it
carries the furthest end so far for each priority.

All of it is column expressions on one row. Marks around matches, characters that no word has,
give the word places of all matches in time proportional to the text.

Defined results: a null text is empty and has no words, labels '' and score 0. Repeated rows and
null ids get a result each. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timedtext.llm.common import MARKS, let, lower_ascii, table

# Fixed base phrases and labels of the contract.
BASE = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Label, keyword that every spelling has (empty: none), and the spellings of the name, in words of
# the reduced text.
NAMES = (
    ("mit", "mit", "mit"),
    ("apache-1.1", "apache", "apache(?: software)? licen[sc]e(?: version)? 1 1|apache 1 1"),
    ("apache-2.0", "apache", "apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?|apache 2(?: 0)?"),
    ("apache", "apache", "apache(?: software)?"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version)? 1"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 2"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:version |v)? ?2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)?(?: version| v)? 3"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:version |v)? ?3(?: 0)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("lgpl-2.1", "lesser general", "(?:gnu )?lesser general public licen[sc]e(?: version| v)? 2 1"),
    ("lgpl-3.0", "lesser general", "(?:gnu )?lesser general public licen[sc]e(?: version| v)? 3"),
    ("lgpl", "lesser general", "(?:gnu )?lesser general public"),
    ("lgpl-2.0", "library general", "(?:gnu )?library general public"),
    ("agpl-3.0", "affero", "(?:gnu )?affero general public"),
    ("gfdl", "free documentation", "(?:gnu )?free documentation"),
    ("bsd-2-clause", "bsd", "(?:2|two) clause bsd|simplified bsd|freebsd|bsd (?:2|two) clause"),
    ("bsd-3-clause", "bsd", "(?:3|three) clause bsd|(?:new|revised|modified) bsd|bsd (?:3|three) clause"),
    ("bsd-4-clause", "bsd", "(?:4|four) clause bsd|original bsd|bsd (?:4|four) clause"),
    ("bsd", "bsd", "bsd(?: style)?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e(?: version| v)? 1 1"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", "mozilla public"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e(?: version| v)? 1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e(?: version| v)? 2(?: 0)?"),
    ("epl", "eclipse", "eclipse public"),
    ("cddl", "development and distribution", "common development and distribution"),
    ("cpl", "common public", "common public"),
    ("eupl", "european union public", "european union public"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e 2(?: 0)?"),
    ("artistic", "artistic", "(?:clarified |perl )?artistic"),
    ("boost", "boost", "boost(?: software)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "want to public", "do what the fuck you want to public"),
    ("postgresql", "postgresql", "postgresql"),
    ("python", "python", "python(?: software foundation)?"),
    ("php", "php", "php"),
    ("openssl", "openssl", "openssl"),
    ("ofl", "open font", "(?:sil )?open font"),
    ("odbl", "open database", "(?:odc )?open database"),
    ("odc-by", "open data commons", "open data commons attribution"),
    ("lgpl-2.0", "lgpl", "(?:gnu )?lgpl ?(?:version |v)? ?2(?: 0)?(?! 1 )"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:version |v)? ?2 1"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?(?:version |v)? ?3(?: 0)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl(?! (?:version |v)?[23] )"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?(?:version |v)? ?1(?: 0)?"),
    ("agpl-1.0", "agpl", "(?:gnu |affero )?agpl ?(?:version |v)? ?1(?: 0)?"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?(?:version |v)? ?3(?: 0)?"),
    ("agpl", "agpl", "(?:gnu )?agpl(?! (?:version |v)?[13] )"),
    ("gfdl-1.1", "gfdl", "(?:gnu )?gfdl ?(?:version |v)? ?1 1"),
    ("gfdl-1.2", "gfdl", "(?:gnu )?gfdl ?(?:version |v)? ?1 2"),
    ("gfdl-1.3", "gfdl", "(?:gnu )?gfdl ?(?:version |v)? ?1 3"),
    ("gfdl", "gfdl", "(?:gnu )?gfdl(?! (?:version |v)?1 [123] )"),
    ("mpl-1.0", "mpl", "mpl ?(?:version |v)? ?1(?: 0)?(?! 1 )"),
    ("mpl-1.1", "mpl", "mpl ?(?:version |v)? ?1 1"),
    ("mpl-2.0", "mpl", "mpl ?(?:version |v)? ?2(?: 0)?"),
    ("mpl", "mpl", "mpl(?! (?:version |v)?[12] )"),
    ("epl-1.0", "epl", "epl ?(?:version |v)? ?1(?: 0)?"),
    ("epl-2.0", "epl", "epl ?(?:version |v)? ?2(?: 0)?"),
    ("epl", "epl", "epl(?! (?:version |v)?[12] )"),
    ("cddl-1.0", "cddl", "cddl ?(?:version |v)? ?1(?: 0)?(?! 1 )"),
    ("cddl-1.1", "cddl", "cddl ?(?:version |v)? ?1 1"),
    ("cddl", "cddl", "cddl(?! (?:version |v)?1 )"),
    ("cpl", "cpl", "cpl ?(?:version |v)? ?1(?: 0)?|cpl"),
    ("eupl", "eupl", "eupl ?(?:version |v)? ?1 [0-2]|eupl"),
    ("ofl", "ofl", "(?:sil )?ofl ?(?:version |v)? ?1 [01](?: rfn| no rfn)?|(?:sil )?ofl"),
    ("bsd-0-clause", "0bsd", "0bsd"),
    ("bsd-0-clause", "clause bsd", "(?:0|zero) clause bsd"),
    ("mit-0", "mit", "mit 0|mit no attribution"),
    ("boost", "bsl", "bsl ?(?:version |v)? ?1(?: 0)?"),
    ("busl-1.1", "busl", "busl 1 1"),
    ("busl-1.1", "business source", "business source"),
    ("libpng", "libpng", "libpng(?: 2 0)?"),
    ("wtfpl", "wtfpl", "wtfpl(?: version 2)?"),
    ("python", "psf", "psf(?: 2 0)?"),
    ("python", "python", "python 2 0(?: 1)?"),
    ("php", "php", "php 3(?: 0| 01)"),
    ("odbl", "odbl", "odbl(?: 1 0)?"),
    ("odc-by", "odc by", "odc by(?: 1 0)?"),
    ("pddl", "pddl", "pddl(?: 1 0)?"),
    ("pddl", "public domain dedication", "(?:odc )?public domain dedication(?: and)?"),
    ("ms-pl", "ms pl", "ms pl"),
    ("ms-pl", "microsoft public", "microsoft public"),
    ("ms-rl", "ms rl", "ms rl"),
    ("ms-rl", "microsoft reciprocal", "microsoft reciprocal"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)?"),
    ("afl", "afl", "afl(?: [1-3] [0-2])?"),
    ("afl", "academic free", "academic free"),
    ("osl", "osl", "osl(?: [1-3] [01])?"),
    ("osl", "open software", "open software"),
    ("apsl", "apsl", "apsl(?: [12] [0-2])?"),
    ("apsl", "apple public source", "apple public source"),
    ("lppl", "lppl", "lppl(?: 1 [0-3][ac]?)?"),
    ("lppl", "latex project public", "latex project public"),
    ("ecl-2.0", "ecl", "ecl 2(?: 0)?"),
    ("ecl-2.0", "educational community", "educational community"),
    ("upl-1.0", "upl", "upl(?: 1 0)?"),
    ("upl-1.0", "universal permissive", "universal permissive"),
    ("sspl-1.0", "sspl", "sspl(?: 1 0)?"),
    ("sspl-1.0", "server side public", "server side public"),
    ("elastic-2.0", "elastic", "elastic(?: 2 0)?"),
    ("cecill", "cecill", "cecill(?: [12] [01]| [bc])?"),
    ("mulan-psl-2.0", "mulan", "mulan(?: permissive software| psl)|mulanpsl(?: 2 0)?"),
    ("qpl", "qpl", "qpl(?: 1 0)?"),
    ("qpl", "q public", "q public"),
    ("x11", "x11", "x11|mit x11"),
    ("curl", "curl", "curl"),
    ("ruby", "ruby", "ruby"),
    ("vim", "vim", "vim"),
    ("ntp", "ntp", "ntp"),
    ("sleepycat", "sleepycat", "sleepycat"),
    ("ijg", "ijg", "ijg"),
    ("ftl", "freetype", "freetype(?: project)?"),
    ("beerware", "beerware", "beerware"),
    ("blueoak-1.0", "blue", "blue ?oak(?: model)?(?: 1 0 0)?"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "", "(?:cc|creative commons) (?:by nc nd|attribution noncommercial noderiv(?:ative)?s)(?: [1-4](?: [05])?)?"),
    ("cc-by-nc-sa", "", "(?:cc|creative commons) (?:by nc sa|attribution noncommercial sharealike)(?: [1-4](?: [05])?)?"),
    ("cc-by-nc", "", "(?:cc|creative commons) (?:by nc|attribution noncommercial)(?: [1-4](?: [05])?)?"),
    ("cc-by-nd", "", "(?:cc|creative commons) (?:by nd|attribution noderiv(?:ative)?s)(?: [1-4](?: [05])?)?"),
    ("cc-by-sa", "", "(?:cc|creative commons) (?:by sa|attribution share ?alike)(?: [1-4](?: [05])?)?"),
    ("cc-by", "", "(?:cc|creative commons) (?:by|attribution)(?: [1-4](?: [05])?)?"),
)

# How a text speaks of a license: priority and words, with the name put in.
FORMS = (
    (0, "spdx licen[sc]e identifier (?:{name})(?: only| or later)?"),
    (1, "(?:is |are |be )?(?:dual )?licen[sc]ed (?:to you )?(?:under|by) (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?"),
    (1, "(?:released|distributed|published|available|provided|made available) under (?:the |an? )?(?:terms (?:and conditions )?of (?:the )?)?(?:{name})(?: licen[sc]e)?(?: version [0-9]+(?: [0-9]+)?)?"),
    (2, "(?:subject to|covered by|governed by|in accordance with) (?:the )?(?:terms of (?:the )?)?(?:{name}) licen[sc]e"),
    (3, "(?:{name}) licen[sc]e(?: agreement| text)?(?: version [0-9]+(?: [0-9]+)?)?"),
)

# Label, keyword, phrase and priority of the licenses' own headers (1) and bodies (2). A longer
# phrase takes the place of the shorter ones that it contains.
BODIES = (
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge(?: to any person obtaining a copy(?: of this software(?: and associated documentation files)?)?)?", 2),
    ("mit", "permission notice shall be included", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", 2),
    ("mit-0", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided", 2),
    ("x11", "in advertising or otherwise", "shall not be used in advertising or otherwise to promote the sale use or other dealings in this software", 2),
    ("boost", "permission is hereby granted", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software", 2),
    ("boost", "machine executable object code", "solely in the form of machine executable object code generated by a source language processor", 2),
    ("ofl", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of the font software", 2),
    ("ofl", "the font software", "neither the font software nor any of its individual components", 2),
    ("unicode", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy of (?:the unicode )?data files", 2),
    ("isc", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", 2),
    ("bsd-0-clause", "permission to use copy modify", "permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software is provided", 2),
    ("hpnd", "permission to use copy modify", "permission to use copy modify (?:and distribute|distribute and sell) this software and its documentation for any purpose", 2),
    ("ntp", "permission to use copy modify", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted", 2),
    ("postgresql", "without a written agreement", "for any purpose without fee and without a written agreement is hereby granted", 2),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms(?: with or without modification(?: are permitted)?)?", 2),
    ("bsd", "redistributions of source code", "redistributions of source code must retain the (?:above )?copyright notice", 2),
    ("bsd", "redistributions in binary form", "redistributions in binary form must reproduce the (?:above )?copyright notice", 2),
    ("bsd-3-clause", "neither the name", "neither the names? of .{1,120}? may be used to endorse or promote products derived from this software", 2),
    ("bsd-3-clause", "may not be used to endorse", "names? of .{1,120}? may not be used to endorse or promote products derived from this software", 2),
    ("bsd-4-clause", "all advertising materials", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment", 2),
    ("apache-2.0", "apache org licenses", "apache org licenses license 2 0", 1),
    ("apache-2.0", "you may not use this file except in compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at(?: https?)? www apache org licenses license 2 0", 1),
    ("apache-2.0", "each contributor hereby grants to you", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|except as stated in this section patent) license", 2),
    ("apache-1.1", "developed by the apache", "this product includes software developed by the apache (?:software foundation|group)", 2),
    ("gpl", "free software you can redistribute", "(?:is|are) free software you can redistribute (?:it|them) and or modify (?:it|them) under the terms of the gnu general public licen[sc]e", 1),
    ("gpl-2.0", "free software you can redistribute", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 2", 1),
    ("gpl-3.0", "free software you can redistribute", "free software you can redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation either version 3", 1),
    ("gpl", "received a copy of the gnu general public", "you should have received a copy of the gnu general public licen[sc]e", 1),
    ("gpl-2.0", "take away your freedom", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public licen[sc]e", 2),
    ("gpl-3.0", "free copyleft license for software", "the gnu general public license is a free copyleft license for software and other kinds of works", 2),
    ("gpl-2.0", "gnu general public license version 2", "gnu general public license version 2 june 1991", 2),
    ("gpl-3.0", "gnu general public license version 3", "gnu general public license version 3 29 june 2007", 2),
    ("lgpl", "free software you can redistribute", "free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[sc]e", 1),
    ("lgpl-2.1", "free software you can redistribute", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1", 1),
    ("lgpl-3.0", "free software you can redistribute", "free software you can redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation either version 3", 1),
    ("lgpl", "received a copy of the gnu lesser general public", "you should have received a copy of the gnu lesser general public licen[sc]e", 1),
    ("lgpl-2.1", "first released version of the lesser", "this is the first released version of the lesser gpl", 2),
    ("lgpl-3.0", "incorporates the terms and conditions", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3", 2),
    ("agpl-3.0", "free software you can redistribute", "free software you can redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e", 1),
    ("agpl-3.0", "received a copy of the gnu affero", "you should have received a copy of the gnu affero general public licen[sc]e", 1),
    ("agpl-3.0", "remote network interaction", "remote network interaction use with the gnu general public license", 2),
    ("gfdl", "permission is granted to copy distribute", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e", 1),
    ("gfdl", "no invariant sections", "with no invariant sections no front cover texts and no back cover texts", 2),
    ("mpl-2.0", "this source code form is subject to", "this source code form is subject to the terms of the mozilla public licen[sc]e v(?:ersion)? ?2 0", 1),
    ("mpl-2.0", "incompatible with secondary licenses", "this source code form is incompatible with secondary licenses", 2),
    ("mpl-1.1", "contents of this file are subject to", "the contents of this file are subject to the mozilla public licen[sc]e version 1 1", 1),
    ("mpl-1.0", "contents of this file are subject to", "the contents of this file are subject to the mozilla public licen[sc]e version 1 0", 1),
    ("mpl-2.0", "mozilla org mpl 2 0", "mozilla org mpl 2 0", 1),
    ("epl-1.0", "eclipse org legal epl v10", "eclipse org legal epl v10", 1),
    ("epl-2.0", "eclipse org legal epl", "eclipse org legal epl (?:2 0|v20)", 1),
    ("epl", "under the terms of this eclipse", "the accompanying program is provided under the terms of this eclipse public licen[sc]e", 2),
    ("cpl", "under the terms of this common public", "the accompanying program is provided under the terms of this common public licen[sc]e", 2),
    ("cddl", "subject to the terms of the common development", "the contents of this file are subject to the terms of the common development and distribution licen[sc]e", 1),
    ("artistic", "semblance of artistic control", "maintains? some semblance of artistic control over the development", 2),
    ("zlib", "freely subject to the following restrictions", "alter it and redistribute it freely subject to the following restrictions", 2),
    ("zlib", "as is without any express or implied", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", 2),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain", 2),
    ("unlicense", "free to copy modify publish", "anyone is free to copy modify publish use compile sell or distribute this software", 2),
    ("wtfpl", "you just do what the fuck", "you just do what the fuck you want to", 2),
    ("beerware", "buy me a beer", "you can buy me a beer in return", 2),
    ("python", "psf hereby grants", "psf hereby grants licensee a nonexclusive royalty free world wide licen[sc]e", 2),
    ("php", "includes php software", "this product includes php software freely available from", 2),
    ("openssl", "developed by the openssl project", "this product includes software developed by the openssl project", 2),
    ("cc0", "waives abandons and surrenders", "affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders", 2),
    ("cc0", "creativecommons org publicdomain zero", "creativecommons org publicdomain zero 1 0", 1),
    *(
        ("cc-" + k.replace(" ", "-"), "creativecommons org licenses", f"creativecommons org licenses {k} [1-4] [05]", 1)
        for k in ("by", "by sa", "by nd", "by nc", "by nc sa", "by nc nd")
    ),
    ("pddl", "opendatacommons org licenses pddl", "opendatacommons org licenses pddl", 1),
    ("odbl", "opendatacommons org licenses odbl", "opendatacommons org licenses odbl", 1),
    ("odc-by", "opendatacommons org licenses by", "opendatacommons org licenses by", 1),
    ("ofl", "scripts sil org ofl", "scripts sil org ofl", 1),
    ("ncsa", "deal with the software without restriction", "to deal with the software without restriction", 2),
    ("ms-pl", "you accept this license if you do not", "if you use the software you accept this license if you do not accept the license do not use the software", 2),
    ("lppl", "latex project public", "distributed and or modified under the conditions of the latex project public licen[sc]e", 1),
)
WEIGHTS = (1.0, 0.95, 0.9, 0.8)
BASE_WEIGHT = 0.8
GATES = (
    "licen", "spdx", "released under", "distributed under", "published under", "available under",
    "provided under", "subject to", "covered by", "governed by", "in accordance with",
)
# A text that speaks of no license in these words may still hold one.
BODY_GATES = tuple(sorted({k for _, k, _, _ in BODIES if not any(g in k for g in GATES)}))
START, END = "\x01", "\x02"


def signatures() -> list[tuple[str, str, str, int]]:
    """Label, keyword, regex and priority of all names in all forms, and of headers and bodies."""
    named = [
        (label, keyword, f"( {form.format(name=name)})(?= )", priority)
        for label, keyword, name in NAMES
        for priority, form in FORMS
    ]
    return named + [(label, keyword, f"( (?:{phrase}))(?= )", priority) for label, keyword, phrase, priority in BODIES]


def reduced(text: Column) -> Column:
    """Words between single spaces, one more at each end."""
    body = F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), MARKS, " ")
    body = F.trim(body)
    return F.when(body == "", " ").otherwise(F.concat(F.lit(" "), body, F.lit(" ")))


def spans(words: Column, regex: Column) -> Column:
    """First and last word, end excluded, of all matches of a regex with one group."""
    marked = F.regexp_replace(words, regex, F.lit(f"{START}$1{END}"))

    def places(parts: Column) -> Column:
        def with_mark(mark: str) -> Column:
            at = F.transform(parts, lambda x, i: F.when(F.contains(x, F.lit(mark)), i))
            return F.filter(at, lambda i: i.isNotNull())

        return F.arrays_zip(with_mark(START).alias("start"), with_mark(END).alias("end"))

    return let(F.split(marked, " "), places)


def base_places(words: Column) -> Column:
    """Start and label of all places of the base phrases."""

    def places(phrase: str, label: str) -> Column:
        hits = F.transform(
            spans(words, F.lit(f"( {phrase})(?= )")),
            lambda s: F.struct(s["start"].alias("start"), F.lit(label).alias("label")),
        )
        empty = F.array().cast("array<struct<start:int,label:string>>")
        return F.when(F.contains(words, F.lit(f" {phrase} ")), hits).otherwise(empty)

    return F.concat(*(places(phrase, label) for phrase, label in BASE))


def detections(words: Column) -> Column:
    """All matches of all signatures whose keyword occurs, sorted for ``surviving``."""
    table = F.array(
        *(
            F.struct(
                F.lit(label).alias("label"),
                F.lit(keyword).alias("keyword"),
                F.lit(regex).alias("regex"),
                F.lit(priority).alias("priority"),
            )
            for label, keyword, regex, priority in signatures()
        )
    )
    tried = F.filter(table, lambda s: F.contains(words, s["keyword"]))

    def of_signature(s: Column) -> Column:
        return F.transform(
            spans(words, s["regex"]),
            lambda m: F.struct(
                m["start"].alias("start"),
                (-m["end"]).alias("minus_end"),
                s["priority"].alias("priority"),
                s["label"].alias("label"),
            ),
        )

    found = F.sort_array(F.flatten(F.transform(tried, of_signature)))
    gate = reduce(lambda a, b: a | b, (F.contains(words, F.lit(g)) for g in GATES + BODY_GATES))
    return F.when(gate, found).otherwise(
        F.array().cast("array<struct<start:int,minus_end:int,priority:int,label:string>>")
    )


def surviving(found: Column) -> Column:
    """Labels of the detections inside no other of the same or a higher priority, and the best
    priority among them. Detections come by start, then longest, then highest priority."""
    levels = len(WEIGHTS)
    zero = F.struct(
        *(F.lit(-1).alias(f"end{p}") for p in range(levels)),
        F.lit(levels).alias("best"),
        F.array().cast("array<string>").alias("labels"),
    )

    def step(so_far: Column, d: Column) -> Column:
        end = -d["minus_end"]
        inside = reduce(
            lambda a, b: a | b,
            ((d["priority"] >= p) & (so_far[f"end{p}"] >= end) for p in range(levels)),
        )
        return F.struct(
            *(
                F.when(~inside & (d["priority"] == p), F.greatest(so_far[f"end{p}"], end))
                .otherwise(so_far[f"end{p}"])
                .alias(f"end{p}")
                for p in range(levels)
            ),
            F.when(inside, so_far["best"]).otherwise(F.least(so_far["best"], d["priority"])).alias("best"),
            F.when(inside, so_far["labels"])
            .otherwise(F.array_union(so_far["labels"], F.array(d["label"])))
            .alias("labels"),
        )

    return F.aggregate(found, zero, step)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, base places, detections (before suppression) and surviving labels."""
    rows = docs.select("doc_id", reduced(F.col("text")).alias("words"))
    rows = rows.select(
        "doc_id",
        (F.length("words") - F.length(F.replace("words", F.lit(" "), F.lit(""))) - 1)
        .cast("bigint")
        .alias("n_words"),
        base_places(F.col("words")).alias("base"),
        detections(F.col("words")).alias("found"),
    )
    return rows.select("*", surviving(F.col("found")).alias("kept"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    base_labels = F.transform("base", lambda b: b["label"])
    weight = F.get(F.array(*map(F.lit, (*WEIGHTS, 0.0))), F.col("kept")["best"])
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("bigint").alias("n_base"),
        F.array_min(starts).cast("bigint").alias("first_word"),
        F.array_max(starts).cast("bigint").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.col("kept")["labels"])), ",").alias("labels"),
        F.greatest(weight, F.when(F.size("base") > 0, BASE_WEIGHT).otherwise(0.0)).alias("score"),
    )
