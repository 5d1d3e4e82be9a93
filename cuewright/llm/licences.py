"""License scans: ordered signature rules, gated by keywords, with built-in functions only.

Four families of rules, in this order of priority: identifiers of SPDX tags, sentences that only one
licence has, addresses, and names. Most rules are a regex of their own; a tag or an address is written
as its identifier or path, and one pattern of the family is put round it. A rule runs only on texts
that hold its keyword. Where found intervals overlap, one that lies inside an interval of a better
(smaller) priority goes.
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .common import any_ids, transcripts
from .spans import spans

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# a text with none of these can match no rule, as each rule demands one of them
GATE = ("licens", "licenc", "spdx", "copyright", "software", "source", "permission", "redistribut", "warrant", "contributor", "disclaims",
        "domain", "commons", "reserved", "cc by", "cc-by", "by-nc", "by-sa", "by-nd", "cc0", "gpl", "wtfpl", "mozilla.org", "eclipse.org",
        "boost.org", "scripts.sil.org", "consortium", "policies", "invariant", "functionality", "freely", "larger", "psl", "waived",
        "fuck", "beer", "blessing", "attribution")
BASE = (("mit", ("mit", "license")), ("apache", ("apache", "license")), ("gpl", ("general", "public", "license")))

V = r"(?:,? ?(?:version|v\.?) ?)"
# (label, keyword, name), more specific names first: the order is the priority. A space stands for any white space
NAMES = (
    ("agpl-3.0", "affero", rf"gnu affero general public licen[cs]e{V}3(?:\.0)?"),
    ("agpl-1.0", "affero", rf"affero general public licen[cs]e{V}1(?:\.0)?"),
    ("agpl", "affero", r"(?:gnu )?affero general public licen[cs]e"),
    ("agpl", "agpl", r"\bagpl(?:[- ]?v?[13](?:\.0)?)?\b"),
    ("lgpl-3.0", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{V}3(?:\.0)?"),
    ("lgpl-2.1", "lesser", rf"(?:gnu )?lesser general public licen[cs]e{V}2\.1"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[cs]e"),
    ("lgpl-2.0", "library", rf"(?:gnu )?library general public licen[cs]e{V}2(?:\.0)?"),
    ("lgpl", "library", r"(?:gnu )?library general public licen[cs]e"),
    ("lgpl-3.0", "lgpl", r"\blgpl[- ]?v?3(?:\.0)?\b"),
    ("lgpl-2.1", "lgpl", r"\blgpl[- ]?v?2\.1\b"),
    ("lgpl", "lgpl", r"\blgpl(?:[- ]?v?2(?:\.0)?)?\b"),
    ("gpl-3.0", "general", rf"gnu general public licen[cs]e{V}3(?:\.0)?"),
    ("gpl-2.0", "general", rf"gnu general public licen[cs]e{V}2(?:\.0)?"),
    ("gpl-1.0", "general", rf"gnu general public licen[cs]e{V}1(?:\.0)?"),
    ("gpl", "general", r"(?:gnu )?general public licen[cs]e"),
    ("gpl-3.0", "gpl", r"\bgpl[- ]?v?3(?:\.0)?\b"),
    ("gpl-2.0", "gpl", r"\bgpl[- ]?v?2(?:\.0)?\b"),
    ("gpl", "gpl", r"\bgpl(?:[- ]?v?1(?:\.0)?)?\b"),
    ("gfdl", "documentation", r"(?:gnu )?free documentation licen[cs]e"),
    ("apache-2.0", "apache", rf"apache (?:software )?licen[cs]e(?:{V}|[- ])2(?:\.0)?"),
    ("apache-1.1", "apache", rf"apache (?:software )?licen[cs]e(?:{V}|[- ])1\.1"),
    ("apache-1.0", "apache", rf"apache (?:software )?licen[cs]e(?:{V}|[- ])1\.0"),
    ("apache-2.0", "apache", r"\bapache[- ]2(?:\.0)? (?:software )?licen[cs]e"),
    ("apache", "apache", r"apache (?:software )?licen[cs]e"),
    ("mit-0", "attribution", r"\bmit no attribution(?: licen[cs]e)?"),
    ("mit", "mit", r"\bmit(?:/x11)? (?:open source )?licen[cs]e"),
    ("mit", "expat", r"\bexpat licen[cs]e"),
    ("x11", "x11", r"\bx11 licen[cs]e"),
    ("bsd-4-clause", "bsd", r"(?:4-clause|four-clause|original) bsd licen[cs]e"),
    ("bsd-3-clause", "bsd", r"(?:3-clause|three-clause|new|modified|revised) bsd licen[cs]e"),
    ("bsd-2-clause", "bsd", r"(?:2-clause|two-clause|simplified|freebsd) bsd licen[cs]e"),
    ("bsd-4-clause", "bsd", r"\bbsd 4-clause licen[cs]e"),
    ("bsd-3-clause", "bsd", r"\bbsd 3-clause licen[cs]e"),
    ("bsd-2-clause", "bsd", r"\bbsd 2-clause licen[cs]e"),
    ("0bsd", "bsd", r"(?:zero-clause|0-clause) bsd licen[cs]e"),
    ("bsd", "bsd", r"\bbsd(?:-style)? licen[cs]e"),
    ("mpl-2.0", "mozilla", rf"mozilla public licen[cs]e{V}2(?:\.0)?"),
    ("mpl-1.1", "mozilla", rf"mozilla public licen[cs]e{V}1\.1"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e"),
    ("epl-2.0", "eclipse", rf"eclipse public licen[cs]e(?:{V}| - v ?)2(?:\.0)?"),
    ("epl-1.0", "eclipse", rf"eclipse public licen[cs]e(?:{V}| - v ?)1(?:\.0)?"),
    ("epl", "eclipse", r"eclipse public licen[cs]e"),
    ("cddl-1.0", "development", r"common development and distribution licen[cs]e"),
    ("cpl-1.0", "common", r"common public licen[cs]e"),
    ("cpal-1.0", "attribution", r"common public attribution licen[cs]e"),
    ("eupl-1.2", "european", rf"european union public licen[cs]e{V}1\.2"),
    ("eupl", "european", r"european union public licen[cs]e"),
    ("artistic-2.0", "artistic", rf"artistic licen[cs]e{V}?2(?:\.0)?"),
    ("artistic", "artistic", r"artistic licen[cs]e"),
    ("isc", "isc", r"\bisc licen[cs]e"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? licen[cs]e"),
    ("boost-1.0", "boost", r"boost software licen[cs]e"),
    ("unlicense", "unlicense", r"\bunlicense\b"),
    ("wtfpl", "wtfpl", r"\bwtfpl\b"),
    ("ncsa", "ncsa", r"(?:university of illinois/)?ncsa open source licen[cs]e"),
    ("python-2.0", "python", r"python software foundation licen[cs]e"),
    ("php-3.01", "php", rf"\bphp licen[cs]e{V}3\.01"),
    ("php", "php", r"\bphp licen[cs]e"),
    ("ruby", "ruby", r"\bruby licen[cs]e"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e"),
    ("openssl", "openssl", r"openssl licen[cs]e"),
    ("sleepycat", "sleepycat", r"sleepycat licen[cs]e"),
    ("bsl-1.1", "business", r"business source licen[cs]e"),
    ("sspl-1.0", "server", r"server side public licen[cs]e"),
    ("elastic-2.0", "elastic", r"elastic licen[cs]e(?: 2(?:\.0)?)?"),
    ("osl-3.0", "open", r"open software licen[cs]e"),
    ("afl-3.0", "academic", r"academic free licen[cs]e"),
    ("ecl-2.0", "educational", r"educational community licen[cs]e"),
    ("ofl-1.1", "font", r"(?:sil )?open font licen[cs]e"),
    ("odbl", "database", r"open (?:data commons )?(?:open )?database licen[cs]e"),
    ("ms-pl", "microsoft", r"microsoft public licen[cs]e"),
    ("ms-rl", "microsoft", r"microsoft reciprocal licen[cs]e"),
    ("vim", "vim", r"\bvim licen[cs]e"),
    ("w3c", "w3c", r"\bw3c software (?:notice and )?licen[cs]e"),
    ("mulan-psl-2.0", "mulan", r"mulan (?:psl|permissive software licen[cs]e)"),
    ("openrail", "rail", r"\b(?:open)?rail(?:-m)? licen[cs]e"),
    ("cc-by-nc-sa", "commons", r"creative commons attribution[- ]non-?commercial[- ]share-?alike"),
    ("cc-by-nc-nd", "commons", r"creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s"),
    ("cc-by-nc", "commons", r"creative commons attribution[- ]non-?commercial"),
    ("cc-by-nd", "commons", r"creative commons attribution[- ]no-?deriv(?:ative)?s"),
    ("cc-by-sa", "commons", r"creative commons attribution[- ]share-?alike"),
    ("cc-by", "commons", r"creative commons attribution"),
    ("cc-by-nc-sa", "by-nc-sa", r"\bcc[- ]by-nc-sa(?:[- ][1-4]\.0)?"),
    ("cc-by-nc-nd", "by-nc-nd", r"\bcc[- ]by-nc-nd(?:[- ][1-4]\.0)?"),
    ("cc-by-nc", "by-nc", r"\bcc[- ]by-nc(?:[- ][1-4]\.0)?"),
    ("cc-by-nd", "by-nd", r"\bcc[- ]by-nd(?:[- ][1-4]\.0)?"),
    ("cc-by-sa", "by-sa", r"\bcc[- ]by-sa(?:[- ][1-4]\.0)?"),
    ("cc-by", "cc by", r"\bcc by(?: [1-4]\.0)?"),
    ("cc-by", "cc-by", r"\bcc-by(?:-[1-4]\.0)?"),
    ("cc0-1.0", "cc0", r"\bcc0(?:[- ]1\.0)?(?: universal)?"),
    ("public-domain", "domain", r"(?:released into the |in the )?public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
)
# (label, identifiers in a tag): with "-only", "-or-later" or "+" after it where a licence has versions
TAGS = (
    ("mit", "mit"), ("mit-0", r"mit-0"), ("x11", "x11"), ("isc", "isc"), ("0bsd", "0bsd"), ("bsd-1-clause", "bsd-1-clause"),
    ("bsd-2-clause", r"bsd-2-clause(?:-patent|-views)?"), ("bsd-3-clause", r"bsd-3-clause(?:-clear|-lbnl|-attribution)?"),
    ("bsd-4-clause", r"bsd-4-clause(?:-uc)?"), ("apache-1.0", r"apache-1\.0"), ("apache-1.1", r"apache-1\.1"), ("apache-2.0", r"apache-2\.0"),
    ("agpl-1.0", r"agpl-1\.0"), ("agpl-3.0", r"agpl-3\.0"), ("gpl-1.0", r"gpl-1\.0"), ("gpl-2.0", r"gpl-2\.0"), ("gpl-3.0", r"gpl-3\.0"),
    ("lgpl-2.0", r"lgpl-2\.0"), ("lgpl-2.1", r"lgpl-2\.1"), ("lgpl-3.0", r"lgpl-3\.0"), ("gfdl", r"gfdl-1\.[1-3]"),
    ("mpl-1.0", r"mpl-1\.0"), ("mpl-1.1", r"mpl-1\.1"), ("mpl-2.0", r"mpl-2\.0(?:-no-copyleft-exception)?"), ("epl-1.0", r"epl-1\.0"),
    ("epl-2.0", r"epl-2\.0"), ("cddl-1.0", r"cddl-1\.0"), ("cddl-1.1", r"cddl-1\.1"), ("cpl-1.0", r"cpl-1\.0"), ("cpal-1.0", r"cpal-1\.0"),
    ("eupl-1.1", r"eupl-1\.1"), ("eupl-1.2", r"eupl-1\.2"), ("artistic", r"artistic-1\.0(?:-perl|-cl8)?"), ("artistic-2.0", r"artistic-2\.0"),
    ("zlib", "zlib"), ("zlib", "libpng-2.0"), ("boost-1.0", r"bsl-1\.0"), ("bsl-1.1", r"busl-1\.1"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("ncsa", "ncsa"), ("python-2.0", r"(?:python|psf)-2\.0(?:\.1)?"), ("php-3.0", r"php-3\.0"), ("php-3.01", r"php-3\.01"), ("ruby", "ruby"),
    ("postgresql", "postgresql"), ("openssl", "openssl"), ("sleepycat", "sleepycat"), ("sspl-1.0", r"sspl-1\.0"), ("elastic-2.0", r"elastic-2\.0"),
    ("osl-3.0", r"osl-3\.0"), ("afl-3.0", r"afl-3\.0"), ("ecl-2.0", r"ecl-2\.0"), ("ofl-1.1", r"ofl-1\.1(?:-rfn|-no-rfn)?"), ("odbl", r"odbl-1\.0"),
    ("odc-by-1.0", r"odc-by-1\.0"), ("pddl-1.0", r"pddl-1\.0"), ("ms-pl", "ms-pl"), ("ms-rl", "ms-rl"), ("vim", "vim"), ("w3c", r"w3c(?:-20150513)?"),
    ("mulan-psl-2.0", r"mulanpsl-2\.0"), ("blueoak-1.0.0", r"blueoak-1\.0\.0"), ("json", "json"), ("curl", "curl"), ("hpnd", "hpnd"), ("icu", "icu"),
    ("unicode", r"unicode-(?:dfs-201[56]|3\.0|tou)"), ("upl-1.0", r"upl-1\.0"), ("tcl", "tcl"), ("beerware", "beerware"), ("blessing", "blessing"),
    ("cc-by", r"cc-by-[1-4]\.[05]"), ("cc-by-sa", r"cc-by-sa-[1-4]\.[05]"), ("cc-by-nd", r"cc-by-nd-[1-4]\.[05]"), ("cc-by-nc", r"cc-by-nc-[1-4]\.[05]"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]"), ("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]"), ("cc0-1.0", r"cc0-1\.0"),
)
# (label, keyword, regex) of sentences; a space stands for white space and the marks of comments
SENTENCES = (
    ("mit", "obtaining", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "merchantability", r"the software is provided [\"'“]?as is[\"'”]?, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability"),
    ("x11", "consortium", r"except as contained in this notice, the name of the x consortium shall not be used"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"),
    ("0bsd", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\."),
    ("isc", "disclaims", r"the author disclaims all warranties with regard to this software"),
    ("postgresql", "agreement", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement"),
    ("hpnd", "supporting", r"that both that copyright notice and this permission notice appear in supporting documentation"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-2-clause", "policies", r"should not be interpreted as representing official policies"),
    ("bsd-3-clause", "endorse", r"neither the names? of .{1,90}? nor the names of (?:its|their|the) contributors may be used to endorse or promote products"),
    ("bsd-3-clause", "endorse", r"may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "apache", r"licensed under the apache license, version 2\.0"),
    ("apache-2.0", "compliance", r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "distributed", r"distributed under the license is distributed on an [\"'“]?as is[\"'”]? basis"),
    ("apache-2.0", "contributor", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache software foundation"),
    ("apache-1.0", "apache", r"this product includes software developed by the apache group"),
    ("gpl-3.0", "foundation", r"under the terms of the gnu general public license as published by the free software foundation, either version 3"),
    ("gpl-2.0", "foundation", r"under the terms of the gnu general public license as published by the free software foundation; either version 2"),
    ("gpl-2.0", "foundation", r"gnu general public license version 2 as published by the free software foundation"),
    ("gpl", "general", r"see the gnu general public license for more details"),
    ("gpl", "general", r"you should have received a copy of the gnu general public license"),
    ("gpl-3.0", "copyleft", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("gpl-2.0", "freedom", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("lgpl-3.0", "foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation,? either version 3"),
    ("lgpl-2.1", "foundation", r"under the terms of the gnu lesser general public license as published by the free software foundation[;,] either version 2\.1"),
    ("lgpl-2.0", "library", r"under the terms of the gnu library general public license as published by the free software foundation[;,] either version 2"),
    ("lgpl", "lesser", r"you should have received a copy of the gnu lesser general public license"),
    ("agpl-3.0", "affero", r"under the terms of the gnu affero general public license as published by the free software foundation, either version 3"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license"),
    ("agpl-3.0", "cooperation", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("gfdl", "invariant", r"with no invariant sections, (?:with )?no front-cover texts,? and (?:with )?no back-cover texts"),
    ("mpl-2.0", "mozilla", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2.0", "incompatible", r"this source code form is [\"'“]?incompatible with secondary licenses"),
    ("mpl-1.1", "contents", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1.0", "contents", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("epl-2.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license (?:v\. ?)?2\.0"),
    ("epl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the eclipse public license v1\.0"),
    ("cddl-1.0", "contents", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl-1.0", "accompanying", r"this program and the accompanying materials are made available under the terms of the common public license"),
    ("eupl", "european", r"licensed under the european union public licence"),
    ("artistic", "artistic", r"the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "artistic", r"copyright holder maintains some artistic control over the development of that package"),
    ("zlib", "as-is", r"this software is provided '?as-is'?, without any express or implied warranty"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("boost-1.0", "boost", r"distributed under the boost software license, version 1\.0"),
    ("boost-1.0", "machine-executable", r"derivative works are solely in the form of machine-executable object code generated by a source language processor"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("wtfpl", "fuck", r"(?:you just )?do what the fuck you want to"),
    ("ncsa", "restriction", r"to deal with the software without restriction"),
    ("python-2.0", "psf", r"psf hereby grants licensee a nonexclusive, royalty-free, world-?wide license"),
    ("php", "freely", r"this product includes php(?: software)?, freely available from"),
    ("openssl", "openssl", r"software developed by the openssl project for use in the openssl toolkit"),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("bsl-1.1", "licensor", r"the licensor may make an additional use grant"),
    ("sspl-1.0", "functionality", r"if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "hosted", r"may not provide the software to third parties as a hosted or managed service"),
    ("ofl-1.1", "font", r"this font software is licensed under the sil open font license, version 1\.1"),
    ("ofl-1.1", "font", r"no modified version of the font software may use the reserved font name"),
    ("odbl", "database", r"this .{1,60}? is made available under the open database license"),
    ("ms-pl", "accept", r"if you use the software, you accept this license"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("beerware", "beer-ware", r"the beer-ware license"),
    ("beerware", "beer", r"you can buy me a beer in return"),
    ("blessing", "blessing", r"in place of a legal notice, here is a blessing"),
    ("upl-1.0", "larger", r"hereby grants? .{0,80}?\blarger works\b"),
    ("cc-by-sa", "commons", r"licensed under (?:a|the) creative commons attribution[- ]share-?alike"),
    ("cc-by", "commons", r"licensed under (?:a|the) creative commons attribution (?:[1-4]\.0 )?(?:international|unported|generic)"),
    ("cc0-1.0", "waived", r"has waived all copyright and related or neighbou?ring rights"),
    ("public-domain", "domain", r"(?:dedicated|released|placed|put) (?:in)?to the public domain"),
    ("public-domain", "disclaims", r"the author disclaims copyright to this source code"),
    ("proprietary", "confidential", r"(?:proprietary and confidential|confidential and proprietary)[^.]{0,80}(?:copyright|licen[cs]e|all rights reserved)"),
    ("proprietary", "prohibited", r"unauthori[sz]ed (?:copying|use|reproduction|distribution)[^.]{0,80} (?:strictly )?prohibited[^.]{0,80}(?:permission|licen[cs]e|copyright)"),
)
# (label, host, path) of addresses
ADDRESSES = (
    ("mit", "opensource.org", r"/licen[cs]es?/mit(?:-license)?"), ("isc", "opensource.org", r"/licen[cs]es?/isc(?:-license)?"),
    ("bsd-2-clause", "opensource.org", r"/licen[cs]es?/bsd-2-clause"), ("bsd-3-clause", "opensource.org", r"/licen[cs]es?/bsd-3-clause"),
    ("apache-2.0", "opensource.org", r"/licen[cs]es?/apache-2(?:\.0|-0)?"), ("gpl-2.0", "opensource.org", r"/licen[cs]es?/gpl-2(?:\.0|-0)?"),
    ("gpl-3.0", "opensource.org", r"/licen[cs]es?/gpl-3(?:\.0|-0)?"), ("lgpl-2.1", "opensource.org", r"/licen[cs]es?/lgpl-2[.-]1"),
    ("lgpl-3.0", "opensource.org", r"/licen[cs]es?/lgpl-3(?:\.0|-0)?"), ("agpl-3.0", "opensource.org", r"/licen[cs]es?/agpl-3\.0"),
    ("mpl-2.0", "opensource.org", r"/licen[cs]es?/mpl-2\.0"), ("epl-2.0", "opensource.org", r"/licen[cs]es?/epl-2\.0"),
    ("cddl-1.0", "opensource.org", r"/licen[cs]es?/cddl-1\.0"), ("artistic-2.0", "opensource.org", r"/licen[cs]es?/artistic-2\.0"),
    ("zlib", "opensource.org", r"/licen[cs]es?/zlib"), ("afl-3.0", "opensource.org", r"/licen[cs]es?/afl-3\.0"),
    ("apache-2.0", "apache.org", r"/licen[cs]es/licen[cs]e-2\.0"), ("apache-1.1", "apache.org", r"/licen[cs]es/licen[cs]e-1\.1"),
    ("agpl-3.0", "gnu.org", r"/licen[cs]es/agpl(?:-3\.0)?"), ("gpl-2.0", "gnu.org", r"/licen[cs]es/(?:old-licenses/)?gpl-2\.0"),
    ("gpl-3.0", "gnu.org", r"/licen[cs]es/gpl-3\.0"), ("gpl", "gnu.org", r"/licen[cs]es/gpl"), ("lgpl-2.1", "gnu.org", r"/licen[cs]es/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "gnu.org", r"/licen[cs]es/lgpl-3\.0"), ("lgpl", "gnu.org", r"/licen[cs]es/lgpl"), ("gfdl", "gnu.org", r"/licen[cs]es/fdl"),
    ("mpl-2.0", "mozilla.org", r"/mpl/2\.0"), ("mpl-1.1", "mozilla.org", r"/mpl/(?:mpl-)?1\.1"), ("mpl", "mozilla.org", r"/mpl/"),
    ("epl-2.0", "eclipse.org", r"/legal/epl-(?:2\.0|v20)"), ("epl-1.0", "eclipse.org", r"/legal/epl-v10"),
    ("boost-1.0", "boost.org", r"/licen[cs]e_1_0\.txt"), ("unlicense", "unlicense.org", ""), ("wtfpl", "wtfpl.net", ""),
    ("ofl-1.1", "scripts.sil.org", r"/ofl(?:.{0,40}licen[cs]e)?"), ("odbl", "opendatacommons.org", r"/licen[cs]es/odbl"), ("pddl-1.0", "opendatacommons.org", r"/licen[cs]es/pddl"),
    ("odc-by-1.0", "opendatacommons.org", r"/licen[cs]es/by"), ("cc-by-nc-sa", "creativecommons.org", r"/licenses/by-nc-sa(?:/[1-4]\.[05])?"),
    ("cc-by-nc-nd", "creativecommons.org", r"/licenses/by-nc-nd(?:/[1-4]\.[05])?"), ("cc-by-nc", "creativecommons.org", r"/licenses/by-nc(?:/[1-4]\.[05])?"),
    ("cc-by-nd", "creativecommons.org", r"/licenses/by-nd(?:/[1-4]\.[05])?"), ("cc-by-sa", "creativecommons.org", r"/licenses/by-sa(?:/[1-4]\.[05])?"),
    ("cc-by", "creativecommons.org", r"/licenses/by(?:/[1-4]\.[05])?"), ("cc0-1.0", "creativecommons.org", r"/publicdomain/zero(?:/1\.0)?"),
    ("public-domain", "creativecommons.org", r"/publicdomain/mark(?:/1\.0)?"),
)
SWEEP = 64       # hits looked at together when those inside others go
WEIGHTS = {"tag": 4.0, "sentence": 3.0, "address": 2.0, "name": 1.0}


@dataclass(frozen=True)
class Signature:
    label: str
    keyword: str
    regex: str
    priority: int
    weight: float


def _signatures():
    """All rules, the best first; of one family the earlier one is better."""
    tag = r"(?<![a-z0-9.+-])(?:{})(?:-only|-or-later|\+)?(?![a-z0-9+-]|\.[a-z0-9])(?<=spdx-licen[cs]e-identifier:[^\n]{{0,160}})"
    families = (
        ("tag", [(label, "spdx", tag.format(name)) for label, name in TAGS]),
        ("sentence", [(label, keyword, text.replace(" ", r"[\s*#/;>]+")) for label, keyword, text in SENTENCES]),
        ("address", [(label, host, re.escape(host) + path) for label, host, path in ADDRESSES]),
        ("name", [(label, keyword, name.replace(" ", r"\s")) for label, keyword, name in NAMES]))
    rules = [(*rule, WEIGHTS[family]) for family, rules in families for rule in rules]
    return tuple(Signature(label, keyword, regex, n, weight) for n, (label, keyword, regex, weight) in enumerate(rules))


SIGNATURES = _signatures()
HITS = "array<struct<start:int,end:int,priority:int,label:string,weight:double>>"


def _hits(low: Column, rules) -> Column:
    """Places of all rules whose keyword is there; a keyword is looked for once, however many rules it has."""
    by_word: dict[str, list[Signature]] = {}
    for rule in rules:
        by_word.setdefault(rule.keyword, []).append(rule)
    table = F.array(*[F.struct(F.lit(word).alias("keyword"), F.array(*[F.struct(
        F.lit(r.label).alias("label"), F.lit(r.regex).alias("regex"), F.lit(r.priority).alias("priority"),
        F.lit(float(r.weight)).alias("weight")) for r in own]).alias("rules")) for word, own in by_word.items()])
    gated = F.filter(table, lambda k: F.contains(low, k["keyword"]))
    gated = F.filter(F.flatten(F.transform(gated, lambda k: k["rules"])), lambda r: F.rlike(low, r["regex"]))
    return F.flatten(F.transform(gated, lambda r: F.transform(spans(low, r["regex"]), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), r["priority"].alias("priority"),
        r["label"].alias("label"), r["weight"].alias("weight")))))


def _outermost(hits: Column) -> Column:
    """Drop every hit that lies inside one of better priority, by a sweep over the starts.

    In the order of (start, longest first) whatever a hit lies in stands before it. SWEEP hits at a time are
    compared with each other and with the earlier ones that reach beyond their first start.
    """
    order = F.array_sort(F.transform(hits, lambda h: F.struct(
        h["start"].alias("start"), (-h["end"]).alias("down"), h["priority"].alias("priority"), h["label"].alias("label"), h["weight"].alias("weight"))))

    def sweep(line: Column) -> Column:
        def step(acc, c):
            own = F.slice(line, c * SWEEP + 1, F.lit(SWEEP))
            pool = F.concat(acc["open"], own)
            kept = F.filter(own, lambda x: ~F.exists(pool, lambda y: (y["start"] <= x["start"]) & (y["down"] <= x["down"]) & (y["priority"] < x["priority"])))
            last = F.element_at(own, -1)["start"]
            return F.struct(F.filter(pool, lambda y: -y["down"] > last).alias("open"), F.concat(acc["kept"], kept).alias("kept"))
        none = F.slice(line, 1, 0)
        steps = F.filter(F.sequence(F.lit(0), F.floor(F.size(line) / SWEEP).cast("int")), lambda c: c * SWEEP < F.size(line))
        return F.aggregate(steps, F.struct(none.alias("open"), none.alias("kept")), step, lambda acc: acc["kept"])
    kept = let(order, sweep)
    return F.transform(kept, lambda h: F.struct(h["start"].alias("start"), (-h["down"]).alias("end"), h["priority"].alias("priority"),
                                                h["label"].alias("label"), h["weight"].alias("weight")))


def _places(words: Column, phrase: tuple[str, ...]) -> Column:
    """Word positions from 0 where the phrase starts."""
    hit = lambda i: F.reduce(F.array(*[F.get(words, i + k) == w for k, w in enumerate(phrase)]),
                             F.lit(True), lambda a, b: a & F.coalesce(b, F.lit(False)))
    starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i) == phrase[0])
    return F.filter(starts, hit)


@any_ids("vid")
def licence_scan(rows: DataFrame, *, rules=SIGNATURES) -> DataFrame:
    """Per transcript: ``vid, n_words, places array<struct<word:int,label:string>>, hits, labels, score``.

    A-Z count as a-z. ``places`` are the phrases of BASE by word position, ``hits`` the signatures
    left after suppression, by code points. ``labels`` is the sorted union, ``score`` grows with the
    weights of the hits from 0 towards 1. NULL and empty texts have no words and score 0; repeated
    rows each get the same answer; other columns are ignored. Nothing is shuffled: each text is
    scanned where it is read, and texts without any word of GATE are left there.
    """
    gated = F.lower("text")  # more than A-Z change, so a text may come in without need, and none is left out
    gated = reduce(or_, [F.contains(gated, F.lit(word)) for word in GATE])
    low = F.when(gated, F.translate("text", UPPER, LOWER))
    words = F.when(gated, F.regexp_extract_all("low", F.lit(WORD), F.lit(0)))
    empty_places = F.array().cast("array<struct<word:int,label:string>>")

    def base(name, phrase):
        named = F.transform(_places(F.col("words"), phrase), lambda i: F.struct(i.alias("word"), F.lit(name).alias("label")))
        return F.when(F.col("low").contains(phrase[-1]), named).otherwise(empty_places)
    places = F.array_sort(F.concat(*[base(name, phrase) for name, phrase in BASE]))
    out = transcripts(rows).select("vid", "text", low.alias("low"))
    out = out.select("vid", F.when(F.col("low").isNull(), F.regexp_count("text", F.lit(WORD))).alias("n"), "low",
                     words.alias("words"))
    out = out.select("vid", F.coalesce("n", F.size("words")).cast("bigint").alias("n_words"),
                     F.when(F.col("low").isNull(), empty_places).otherwise(places).alias("places"),
                     F.when(F.col("low").isNull(), F.array().cast(HITS)).otherwise(_hits(F.col("low"), rules)).alias("found"))
    out = out.select("vid", "n_words", "places", _outermost(F.col("found")).alias("hits"))
    labels = F.array_sort(F.array_distinct(F.concat(F.transform("places", lambda p: p["label"]),
                                                    F.transform("hits", lambda h: h["label"]))))
    total = F.aggregate("hits", F.lit(0.0), lambda a, h: a + h["weight"])
    return out.select("vid", "n_words", "places", "hits", labels.alias("labels"), (total / (total + 4.0)).alias("score"))
