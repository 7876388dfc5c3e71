"""License scan of whole texts in DataFrame functions only.

A text is brought to one form: A-Z in lower case, every run of other ASCII than letters and digits one space. Signature
rules are expressions over that form, some hundreds written by hand: notices, and names of licenses. A rule is tried only
where its keyword stands. Every expression is a literal, so Spark compiles it once; where a match lies is told by looking
for its words from the end of the match before. Detections are resolved by priority and containment: one that lies within
another of the same or a higher priority goes.

A name also counts within statements (that a work is distributed under it, say), which are built from the names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import LOWER, UPPER, read, text_of

_SEPARATORS = "".join(chr(c) for c in range(128) if not chr(c).isalnum())

#: Base phrases (fixed values) and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: label, keyword, name as it stands in the text's form.
NAMES = [
    ("apache-1.0", "apache", "apache (?:software )?licen[sc]e,? (?:version |v)?1 0"),
    ("apache-1.1", "apache", "apache (?:software )?licen[sc]e (?:version |v)?1 1"),
    ("apache-2.0", "apache", "apache(?: software)?(?: licen[sc]e)? ?(?:version |v)?2(?: 0)?(?: licen[sc]e)?"),
    ("apache", "apache", "apache (?:software )?licen[sc]e"),
    ("mit", "mit", "mit(?: x11)? licen[sc]e"),
    ("mit", "expat", "expat licen[sc]e"),
    ("mit-0", "mit", "mit (?:no attribution|0)(?: licen[sc]e)?"),
    ("x11", "x11", "x11 licen[sc]e"),
    ("bsd-0-clause", "bsd", "(?:zero|0) clause bsd(?: licen[sc]e)?"),
    ("bsd-2-clause", "bsd", "(?:(?:2|two) clause (?:bsd|freebsd)|(?:simplified|freebsd) bsd|bsd 2 clause)(?: licen[sc]e)?"),
    ("bsd-3-clause", "bsd", "(?:(?:3|three) clause bsd|(?:new|revised|modified) bsd|bsd 3 clause)(?: licen[sc]e)?"),
    ("bsd-4-clause", "bsd", "(?:(?:4|four) clause bsd|original bsd|bsd 4 clause)(?: licen[sc]e)?"),
    ("bsd", "bsd", "bsd (?:style )?licen[sc]e"),
    ("gpl-1.0", "gpl", "(?:gnu )?gpl ?(?:version |v )?v?1(?: 0)?(?: or later| only)?"),
    ("gpl-2.0", "gpl", "(?:gnu )?gpl ?(?:version |v )?v?2(?: 0)?(?: or later| only)?"),
    ("gpl-3.0", "gpl", "(?:gnu )?gpl ?(?:version |v )?v?3(?: 0)?(?: or later| only)?"),
    ("gpl", "gpl", "(?:gnu )?gpl"),
    ("gpl-1.0", "general public", "(?:gnu )?general public licen[sc]e (?:version |v )?v?1(?: 0)?"),
    ("gpl-2.0", "general public", "(?:gnu )?general public licen[sc]e (?:version |v )?v?2(?: 0)?"),
    ("gpl-3.0", "general public", "(?:gnu )?general public licen[sc]e (?:version |v )?v?3(?: 0)?"),
    ("gpl", "general public", "(?:gnu )?general public licen[sc]e"),
    ("lgpl-2.0", "general public", "(?:gnu )?(?:lesser|library) general public licen[sc]e (?:version |v )?v?2(?: 0)?"),
    ("lgpl-2.1", "general public", "(?:gnu )?lesser general public licen[sc]e (?:version |v )?v?2 1"),
    ("lgpl-3.0", "general public", "(?:gnu )?lesser general public licen[sc]e (?:version |v )?v?3(?: 0)?"),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public licen[sc]e"),
    ("agpl-3.0", "general public", "(?:gnu )?affero general public licen[sc]e(?: (?:version |v )?v?3(?: 0)?)?"),
    ("lgpl-2.1", "lgpl", "(?:gnu )?lgpl ?(?:version |v )?v?2 1(?: or later| only)?"),
    ("lgpl-3.0", "lgpl", "(?:gnu )?lgpl ?(?:version |v )?v?3(?: 0)?(?: or later| only)?"),
    ("lgpl", "lgpl", "(?:gnu )?lgpl"),
    ("agpl-3.0", "agpl", "(?:gnu )?agpl ?(?:version |v )?v?3(?: 0)?(?: or later| only)?"),
    ("gfdl-1.3", "documentation", "(?:gnu )?free documentation licen[sc]e(?: (?:version |v )?v?1 [123])?"),
    ("mpl-1.1", "mozilla", "mozilla public licen[sc]e (?:version |v )?v?1 [01]"),
    ("mpl-2.0", "mozilla", "mozilla public licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    ("epl-1.0", "eclipse", "eclipse public licen[sc]e (?:version |v )?v?1(?: 0)?"),
    ("epl-2.0", "eclipse", "eclipse public licen[sc]e(?: (?:version |v )?v?2(?: 0)?)?"),
    ("edl-1.0", "eclipse", "eclipse distribution licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    ("cddl-1.0", "development and distribution", "common development and distribution licen[sc]e(?: (?:version |v )?v?1 [01])?"),
    ("cpl-1.0", "common public", "common public licen[sc]e(?: (?:version |v )?v?1 0)?"),
    ("eupl-1.2", "european union", "european union public licen[sc]e(?: (?:version |v )?v?1 [012])?"),
    ("ms-pl", "microsoft", "microsoft public licen[sc]e"),
    ("ms-rl", "microsoft", "microsoft reciprocal licen[sc]e"),
    ("isc", "isc", "isc licen[sc]e"),
    ("zlib", "zlib", "zlib(?: libpng)? licen[sc]e"),
    ("libpng", "libpng", "libpng licen[sc]e"),
    ("bsl-1.0", "boost", "boost software licen[sc]e(?: (?:version |v )?1 0)?"),
    ("busl-1.1", "business source", "business source licen[sc]e(?: (?:version |v )?1 1)?"),
    ("sspl-1.0", "server side", "server side public licen[sc]e(?: (?:version |v )?v?1(?: 0)?)?"),
    ("elastic-2.0", "elastic", "elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?"),
    ("artistic-1.0", "artistic", "artistic licen[sc]e (?:version |v )?1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic licen[sc]e(?: (?:version |v )?2(?: 0)?)?"),
    ("perl", "perl", "(?:same terms as perl|perl artistic licen[sc]e)"),
    ("python-2.0", "python", "python software foundation licen[sc]e(?: (?:version )?2)?"),
    ("php-3.01", "php", "php licen[sc]e(?: (?:version |v )?3(?: 0?1)?)?"),
    ("ruby", "ruby", "ruby licen[sc]e"),
    ("openssl", "openssl", "openssl licen[sc]e"),
    ("ofl-1.1", "open font", "sil open font licen[sc]e(?: (?:version |v )?1 [01])?"),
    ("odbl-1.0", "open database", "open database licen[sc]e(?: (?:version |v )?1 0)?"),
    ("odc-by", "open data commons", "open data commons attribution licen[sc]e"),
    ("pddl-1.0", "open data commons", "open data commons public domain dedication and licen[sc]e"),
    ("wtfpl", "wtfpl", "wtfpl(?: licen[sc]e)?(?: (?:version |v )?2)?"),
    ("unlicense", "unlicense", "unlicense"),
    ("upl-1.0", "universal permissive", "universal permissive licen[sc]e(?: (?:version |v )?v?1 0)?"),
    ("ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? licen[sc]e"),
    ("postgresql", "postgresql", "postgresql licen[sc]e"),
    ("vim", "vim", "vim licen[sc]e"),
    ("w3c", "w3c", "w3c software (?:notice and )?licen[sc]e"),
    ("osl-3.0", "open software", "open software licen[sc]e(?: (?:version |v )?3(?: 0)?)?"),
    ("afl-3.0", "academic free", "academic free licen[sc]e(?: (?:version |v )?3(?: 0)?)?"),
    ("qpl-1.0", "q public", "q public licen[sc]e(?: (?:version )?1 0)?"),
    ("apsl-2.0", "apple public", "apple public source licen[sc]e(?: (?:version )?2 0)?"),
    ("ipl-1.0", "ibm public", "ibm public licen[sc]e(?: (?:version )?1 0)?"),
    ("cecill-2.1", "cecill", "cecill(?: [bc])?(?: free software)?(?: licen[sc]e)?(?: (?:version |v )?2 [01])?"),
    ("mulan-2.0", "mulan", "mulan (?:permissive software|psl|public) ?(?:licen[sc]e)?(?: ?v?2)?"),
    ("open-government", "open government", "open government licen[sc]e(?: (?:version |v )?v?[123](?: 0)?)?"),
    ("openrail", "openrail", "(?:creativeml )?openrail ?m?(?: licen[sc]e)?"),
    ("llama", "community licen", "[a-z0-9]+(?: [0-9])* community licen[sc]e agreement"),
    ("cc0-1.0", "cc0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?(?: international)?"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?(?: international)?"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?(?: international)?"),
    ("cc-by-nc-nd", "creative commons", "creative commons attribution non ?commercial no ?deriv(?:ative)?(?:ive)?s?(?: works)?(?: [1-4] [05])?"),
    ("cc-by-nc-sa", "creative commons", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?"),
    ("cc-by-nc", "creative commons", "creative commons attribution non ?commercial(?: [1-4] [05])?"),
    ("cc-by-nd", "creative commons", "creative commons attribution no ?deriv(?:ative)?(?:ive)?s?(?: [1-4] [05])?"),
    ("cc-by-sa", "creative commons", "creative commons attribution share ?alike(?: [1-4] [05])?"),
    ("cc-by", "creative commons", "creative commons attribution(?: [1-4] [05])?"),
    ("cc0-1.0", "creative commons", "creative commons (?:cc0|zero|public domain dedication)"),
    ("public-domain", "public domain", "public domain"),
]

#: priority, expression with the name in place of %s. A smaller number is a higher priority.
STATEMENTS = [
    (2, "(?:licen[sc]ed|released|distributed|published|provided|available|covered|dual licen[sc]ed|redistributed|governed)(?: to you)? (?:under|by)(?: the)?(?: terms(?: and conditions)? of)?(?: the)?(?: either)? %s(?: licen[sc]e)?"),
    (2, "spdx licen[sc]e identifier %s"),
    (2, "licen[sc]e (?:is |type |name )?(?:the )?%s"),
    (3, "%s"),
]

#: label, keyword, priority, expression: notices of the licenses themselves.
NOTICES = [
    ("mit", "permission is hereby", 1, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("isc", "permission to use", 1, "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use", 1, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "neither the name", 1, "neither the names? of .{1,120}? may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "all advertising", 1, "all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("gpl", "free software foundation", 1, "redistribute it and or modify it under the terms of the gnu general public licen[sc]e as published by the free software foundation"),
    ("lgpl", "free software foundation", 1, "redistribute it and or modify it under the terms of the gnu lesser general public licen[sc]e as published by the free software foundation"),
    ("agpl-3.0", "free software foundation", 1, "redistribute it and or modify it under the terms of the gnu affero general public licen[sc]e as published by the free software foundation"),
    ("apache-2.0", "apache", 1, "licen[sc]ed under the apache licen[sc]e version 2 0 the licen[sc]e you may not use this file except in compliance with the licen[sc]e"),
    ("mpl-2.0", "source code form", 1, "this source code form is subject to the terms of the mozilla public licen[sc]e v 2 0"),
    ("unlicense", "public domain", 1, "this is free and unencumbered software released into the public domain"),
    ("zlib", "implied warranty", 1, "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1.0", "boost", 1, "distributed under the boost software licen[sc]e version 1 0"),
    ("wtfpl", "what the", 1, "do what the fuck you want to(?: public licen[sc]e)?"),
    ("no-warranty", "warrant", 2, "(?:without warrant(?:y|ies) of any kind|without any warranty|without warranties or conditions of any kind)"),
    ("cc-by", "creativecommons", 2, "creativecommons org licen[sc]es by [1-4] [05]"),
    ("cc-by-sa", "creativecommons", 2, "creativecommons org licen[sc]es by sa [1-4] [05]"),
    ("cc-by-nc", "creativecommons", 2, "creativecommons org licen[sc]es by nc [1-4] [05]"),
    ("cc-by-nd", "creativecommons", 2, "creativecommons org licen[sc]es by nd [1-4] [05]"),
    ("cc-by-nc-sa", "creativecommons", 2, "creativecommons org licen[sc]es by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "creativecommons", 2, "creativecommons org licen[sc]es by nc nd [1-4] [05]"),
    ("cc0-1.0", "creativecommons", 2, "creativecommons org publicdomain zero 1 0"),
    ("reserved", "rights reserved", 3, "(?:all|some) rights reserved"),
    ("copyright", "copyright", 3, "copyright (?:c )?(?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?"),
    ("proprietary", "confidential", 2, "(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthori", 2, "unauthori[sz]ed (?:copying|use|reproduction|distribution) .{0,80}?(?:is )?(?:strictly )?prohibited"),
    ("non-commercial", "commercial", 2, "for non ?commercial (?:use|purposes) only"),
    ("mit", "shall be included", 1, "the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit", "without limitation the rights", 1, "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "opensource org", 2, "opensource org licen[sc]es mit"),
    ("x11", "x consortium", 1, "except as contained in this notice the name of the x consortium shall not be used in advertising"),
    ("mit-0", "no attribution", 2, "mit no attribution"),
    ("hpnd", "its documentation", 1, "permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose .{0,60}?is hereby granted"),
    ("hpnd", "supporting documentation", 2, "both that copyright notice and this permission notice appear in supporting documentation"),
    ("isc", "above copyright notice", 1, "provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "opensource org", 2, "opensource org licen[sc]es isc"),
    ("0bsd", "opensource org", 2, "opensource org licen[sc]es 0bsd"),
    ("bsd-2-clause", "opensource org", 2, "opensource org licen[sc]es bsd 2 clause"),
    ("bsd-3-clause", "opensource org", 2, "opensource org licen[sc]es bsd 3 clause"),
    ("bsd", "retain the above", 1, "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "reproduce the above", 1, "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation"),
    ("bsd", "licen", 2, "use of this source code is governed by an? bsd style licen[sc]e that can be found in the licen[sc]e file"),
    ("bsd-3-clause", "without specific prior", 1, "may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "university of california", 1, "this product includes software developed by the university of california berkeley and its contributors"),
    ("bsd-3-clause-clear", "patent", 1, "no express or implied licen[sc]es to any party s patent rights are granted by this licen[sc]e"),
    ("bsd-2-clause-patent", "patent", 1, "each copyright holder and contributor .{0,40}?hereby grants .{0,80}?patent licen[sc]e"),
    ("openssl", "openssl", 1, "this product includes software developed by the openssl project"),
    ("openssl", "eric young", 1, "this product includes (?:cryptographic )?software written by eric young"),
    ("apache-2.0", "apache org", 2, "apache org licen[sc]es licen[sc]e 2 0"),
    ("apache-2.0", "january 2004", 1, "apache licen[sc]e version 2 0 january 2004"),
    ("apache-2.0", "grant of copyright", 1, "grant of copyright licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you"),
    ("apache-2.0", "grant of patent", 1, "grant of patent licen[sc]e subject to the terms and conditions of this licen[sc]e each contributor hereby grants to you"),
    ("apache-2.0", "apache software foundation", 1, "licen[sc]ed to the apache software foundation asf under one or more contributor licen[sc]e agreements"),
    ("apache-1.1", "apache software foundation", 1, "this product includes software developed by the apache software foundation"),
    ("gpl-1.0", "general public", 1, "gnu general public licen[sc]e version 1 february 1989"),
    ("gpl-2.0", "general public", 1, "gnu general public licen[sc]e version 2 june 1991"),
    ("gpl-3.0", "general public", 1, "gnu general public licen[sc]e version 3 29 june 2007"),
    ("lgpl-2.0", "general public", 1, "gnu library general public licen[sc]e version 2 june 1991"),
    ("lgpl-2.1", "general public", 1, "gnu lesser general public licen[sc]e version 2 1 february 1999"),
    ("lgpl-3.0", "general public", 1, "gnu lesser general public licen[sc]e version 3 29 june 2007"),
    ("agpl-3.0", "general public", 1, "gnu affero general public licen[sc]e version 3 19 november 2007"),
    ("gfdl-1.1", "documentation", 1, "gnu free documentation licen[sc]e version 1 1 march 2000"),
    ("gfdl-1.2", "documentation", 1, "gnu free documentation licen[sc]e version 1 2 november 2002"),
    ("gfdl-1.3", "documentation", 1, "gnu free documentation licen[sc]e version 1 3 3 november 2008"),
    ("gfdl-1.3", "invariant sections", 1, "with no invariant sections no front cover texts and no back cover texts"),
    ("gpl-2.0", "free software foundation", 1, "free software foundation either version 2 of the licen[sc]e or at your option any later version"),
    ("gpl-3.0", "free software foundation", 1, "free software foundation either version 3 of the licen[sc]e or at your option any later version"),
    ("lgpl-2.1", "free software foundation", 1, "free software foundation either version 2 1 of the licen[sc]e or at your option any later version"),
    ("gpl-2.0", "version 2", 2, "under the terms of (?:the )?gnu general public licen[sc]e version 2 as published"),
    ("gpl", "general public", 2, "you should have received a copy of the gnu general public licen[sc]e along with this (?:program|software|file|library)"),
    ("lgpl", "general public", 2, "you should have received a copy of the gnu lesser general public licen[sc]e along with this (?:program|software|file|library)"),
    ("agpl-3.0", "general public", 2, "you should have received a copy of the gnu affero general public licen[sc]e along with this (?:program|software|file|library)"),
    ("gpl", "gnu org", 2, "gnu org (?:licen[sc]es|copyleft) gpl(?: [123] 0)?"),
    ("lgpl", "gnu org", 2, "gnu org (?:licen[sc]es|copyleft) lgpl(?: [23] [01])?"),
    ("agpl-3.0", "gnu org", 2, "gnu org licen[sc]es agpl(?: 3 0)?"),
    ("gfdl-1.3", "gnu org", 2, "gnu org (?:licen[sc]es|copyleft) fdl(?: 1 [123])?"),
    ("gpl-classpath", "special exception", 1, "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-classpath", "classpath", 2, "(?:gpl|general public licen[sc]e) .{0,30}?with (?:the )?classpath exception"),
    ("gpl-gcc-exception", "runtime library", 1, "gcc runtime library exception(?: version 3 1)?"),
    ("gpl-font-exception", "special exception", 1, "as a special exception if you create a document which uses this font"),
    ("gpl-bison-exception", "special exception", 1, "as a special exception you may create a larger work that contains part or all of the bison parser skeleton"),
    ("gpl-autoconf-exception", "autoconf", 1, "as a special exception .{0,120}?configuration script generated by autoconf"),
    ("gpl-linux-syscall", "syscall", 2, "linux syscall note"),
    ("mpl-1.0", "mozilla", 1, "the contents of this file are subject to the mozilla public licen[sc]e version 1 0"),
    ("mpl-1.1", "mozilla", 1, "the contents of this file are subject to the mozilla public licen[sc]e version 1 1"),
    ("mpl-2.0", "mozilla org", 2, "mozilla org mpl 2 0"),
    ("mpl-1.1", "mozilla org", 2, "mozilla org mpl(?: mpl)? 1 1"),
    ("mpl-2.0", "secondary licen", 1, "incompatible with secondary licen[sc]es as defined by the mozilla public licen[sc]e"),
    ("npl-1.1", "netscape", 1, "the contents of this file are subject to the netscape public licen[sc]e"),
    ("epl-1.0", "eclipse org", 2, "eclipse org legal epl v10"),
    ("epl-2.0", "eclipse org", 2, "eclipse org legal epl (?:2 0|v20)"),
    ("edl-1.0", "eclipse org", 2, "eclipse org org documents edl v10"),
    ("epl-1.0", "accompanying materials", 1, "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e v1 0"),
    ("epl-2.0", "accompanying materials", 1, "this program and the accompanying materials are made available under the terms of the eclipse public licen[sc]e (?:v )?2 0"),
    ("cpl-1.0", "accompanying", 1, "the accompanying program is provided under the terms of this common public licen[sc]e"),
    ("cddl-1.0", "common development", 1, "the contents of this file are subject to the terms of the common development and distribution licen[sc]e"),
    ("cddl-1.1", "common development", 1, "common development and distribution licen[sc]e cddl version 1 1"),
    ("eupl-1.1", "eupl", 2, "eupl (?:version |v )?1 1"),
    ("eupl-1.2", "eupl", 2, "eupl (?:version |v )?1 2"),
    ("ms-pl", "opensource org", 2, "opensource org licen[sc]es ms pl"),
    ("ms-lpl", "microsoft", 1, "microsoft limited public licen[sc]e"),
    ("ms-eula", "microsoft", 2, "microsoft software licen[sc]e terms"),
    ("zlib", "misrepresented", 1, "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", "altered source", 1, "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("libpng", "libpng", 1, "this code is released under the libpng licen[sc]e"),
    ("bsl-1.0", "boost org", 2, "boost org licen[sc]e 1 0"),
    ("bsl-1.0", "machine executable", 1, "solely in the form of machine executable object code generated by a source language processor"),
    ("busl-1.1", "change date", 1, "effective on the change date .{0,160}?under the terms of the change licen[sc]e"),
    ("busl-1.1", "mariadb", 2, "mariadb (?:com|corporation) .{0,30}?business source licen[sc]e"),
    ("sspl-1.0", "functionality of the program", 1, "if you make the functionality of the program or a modified version available to third parties as a service"),
    ("elastic-2.0", "managed service", 1, "you may not provide the software to third parties as a hosted or managed service"),
    ("commons-clause", "right to sell", 1, "the licen[sc]e does not grant to you the right to sell the software"),
    ("commons-clause", "commons clause", 2, "commons clause(?: licen[sc]e)? condition"),
    ("polyform-noncommercial", "polyform", 2, "polyform noncommercial(?: licen[sc]e)?(?: 1 0 0)?"),
    ("polyform-small-business", "polyform", 2, "polyform small business(?: licen[sc]e)?(?: 1 0 0)?"),
    ("polyform-strict", "polyform", 2, "polyform (?:strict|shield|perimeter)(?: licen[sc]e)?(?: 1 0 0)?"),
    ("fsl-1.1", "functional source", 2, "functional source licen[sc]e(?: version)? 1 [01]"),
    ("hippocratic-2.1", "hippocratic", 2, "hippocratic licen[sc]e(?: (?:version )?[123] [01])?"),
    ("artistic-1.0", "artistic", 1, "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2.0", "artistic", 1, "the artistic licen[sc]e 2 0 copyright c 2000 2006 the perl foundation"),
    ("perl", "perl itself", 1, "you can redistribute it and or modify it under the same terms as perl itself"),
    ("python-2.0", "psf hereby", 1, "psf hereby grants licen[sc]ee a nonexclusive royalty free world wide licen[sc]e"),
    ("cnri-python", "cnri", 1, "cnri hereby grants licen[sc]ee a nonexclusive royalty free"),
    ("zpl-2.1", "zope", 2, "zope public licen[sc]e(?: (?:zpl )?version 2 [01])?"),
    ("php-3.01", "php", 1, "this product includes php software freely available from"),
    ("ruby", "ruby", 1, "ruby is copyrighted free software by yukihiro matsumoto"),
    ("tcl", "sun microsystems", 1, "this software is copyrighted by the regents of the university of california sun microsystems"),
    ("ofl-1.1", "scripts sil org", 2, "scripts sil org ofl"),
    ("ofl-1.1", "reserved font name", 1, "with reserved font names? .{0,60}?this font software is licen[sc]ed under the sil open font licen[sc]e version 1 1"),
    ("bitstream-vera", "fonts accompanying", 1, "permission is hereby granted free of charge to any person obtaining a copy of the fonts accompanying this licen[sc]e"),
    ("ubuntu-font", "ubuntu font", 2, "ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("odbl-1.0", "opendatacommons", 2, "opendatacommons org licen[sc]es odbl(?: (?:1 0|summary))?"),
    ("odc-by", "opendatacommons", 2, "opendatacommons org licen[sc]es by(?: (?:1 0|summary))?"),
    ("pddl-1.0", "opendatacommons", 2, "opendatacommons org licen[sc]es pddl(?: (?:1 0|summary))?"),
    ("cdla-permissive-2.0", "community data", 2, "community data licen[sc]e agreement permissive (?:version )?[12] 0"),
    ("cdla-sharing-1.0", "community data", 2, "community data licen[sc]e agreement sharing (?:version )?1 0"),
    ("cc0-1.0", "possible under law", 1, "to the extent possible under law .{0,80}?has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "cc0", 2, "cc0 1 0 universal (?:cc0 1 0 )?public domain dedication"),
    ("cc-by", "creative commons", 1, "this work is licen[sc]ed under (?:a|the) creative commons attribution [1-4] [05] (?:international|unported|generic) licen[sc]e"),
    ("cc-by-sa", "creative commons", 1, "this work is licen[sc]ed under (?:a|the) creative commons attribution share ?alike [1-4] [05] (?:international|unported|generic) licen[sc]e"),
    ("cc-by-nc", "creative commons", 1, "this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial [1-4] [05] (?:international|unported|generic) licen[sc]e"),
    ("cc-by-nd", "creative commons", 1, "this work is licen[sc]ed under (?:a|the) creative commons attribution no ?derivatives [1-4] [05] (?:international|unported|generic) licen[sc]e"),
    ("cc-by-nc-sa", "creative commons", 1, "this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial share ?alike [1-4] [05] (?:international|unported|generic) licen[sc]e"),
    ("cc-by-nc-nd", "creative commons", 1, "this work is licen[sc]ed under (?:a|the) creative commons attribution non ?commercial no ?derivatives [1-4] [05] (?:international|unported|generic) licen[sc]e"),
    ("cc-by-sa", "text is available", 1, "text is available under the creative commons attribution share ?alike licen[sc]e"),
    ("public-domain", "public domain", 2, "(?:placed|released|dedicated|put) (?:in|into|to) the public domain"),
    ("public-domain", "no copyright is", 2, "no copyright is claimed"),
    ("public-domain", "united states government", 1, "(?:this (?:software|work) was (?:developed|prepared) .{0,60}?employees of the|a work of the) united states government"),
    ("public-domain", "disclaims copyright", 1, "the author disclaims copyright to this source code"),
    ("unlicense", "unlicense org", 2, "(?:http |https )?(?:www )?unlicense org"),
    ("unlicense", "free to copy", 1, "anyone is free to copy modify publish use compile sell or distribute this software"),
    ("wtfpl", "wtfpl net", 2, "wtfpl net"),
    ("beerware", "beer", 1, "(?:if we meet some day and you think this stuff is worth it you can buy me a beer|beer ?ware licen[sc]e)"),
    ("json", "good not evil", 1, "the software shall be used for good not evil"),
    ("curl", "curl", 2, "curl licen[sc]e"),
    ("ncsa", "deal with the software", 1, "permission is hereby granted .{0,160}?to deal with the software without restriction"),
    ("ncsa", "illinois", 2, "university of illinois ncsa open source licen[sc]e"),
    ("llvm-exception", "llvm", 1, "apache licen[sc]e v(?:ersion )?2 0 with llvm exceptions?"),
    ("icu", "unicode", 1, "(?:unicode licen[sc]e v3|unicode inc licen[sc]e agreement data files and software)"),
    ("unicode-dfs", "unicode", 1, "permission is hereby granted free of charge to any person obtaining a copy of the unicode data files"),
    ("postgresql", "written agreement", 1, "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("vim", "charityware", 1, "vim is charityware"),
    ("ijg", "independent jpeg", 1, "this software is based in part on the work of the independent jpeg group"),
    ("freetype", "freetype", 1, "portions of this software are copyright .{0,40}?the freetype project"),
    ("info-zip", "info zip", 1, "copyright c [0-9 ]{4,12}info zip all rights reserved"),
    ("bzip2", "bzip2", 1, "this program bzip2 the associated library libbzip2 and all documentation are copyright"),
    ("w3c", "w3 org", 2, "w3 org consortium legal"),
    ("osl-3.0", "opensource org", 2, "opensource org licen[sc]es osl 3 0"),
    ("afl-3.0", "opensource org", 2, "opensource org licen[sc]es afl 3 0"),
    ("upl-1.0", "larger work", 1, "to any person obtaining a copy of this software associated documentation and or data .{0,160}?larger works? as defined below"),
    ("cecill-2.1", "cecill info", 2, "(?:www )?cecill info"),
    ("mulan-2.0", "mulan", 1, "you can use this software according to the terms and conditions of the mulan psl v2"),
    ("open-government", "nationalarchives", 2, "nationalarchives gov uk doc open government licen[sc]e"),
    ("open-government", "public sector information", 1, "contains public sector information licen[sc]ed under the open government licen[sc]e"),
    ("etalab-2.0", "etalab", 2, "etalab open licen[sc]e(?: v?2 0)?"),
    ("etalab-2.0", "licence ouverte", 2, "licence ouverte(?: v?2 0)?"),
    ("dl-de-by-2.0", "datenlizenz", 2, "datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("dl-de-zero-2.0", "datenlizenz", 2, "datenlizenz deutschland zero(?: version)? 2 0"),
    ("openrail", "use restrictions", 1, "you agree not to use the model or derivatives of the model in violation of the use restrictions"),
    ("llama", "monthly active users", 1, "greater than 700 million monthly active users"),
    ("gemma", "gemma", 2, "gemma terms of use"),
    ("nvidia", "nvidia", 2, "nvidia (?:open model|source code|software) licen[sc]e(?: agreement)?"),
    ("oracle-otn", "oracle", 2, "oracle technology network licen[sc]e agreement"),
    ("oracle-bcl", "oracle", 2, "oracle binary code licen[sc]e agreement"),
    ("intel-simplified", "intel", 2, "intel simplified software licen[sc]e"),
    ("adobe", "adobe", 2, "adobe systems incorporated .{0,30}?source code licen[sc]e agreement"),
    ("facebook-patents", "patents file", 2, "an additional grant of patent rights can be found in the patents file"),
    ("no-warranty", "as is", 2, "the software is provided as is without warranty of any kind express or implied"),
    ("no-warranty", "as is", 2, "this software is provided by the (?:copyright holders and contributors|author|regents and contributors) as is"),
    ("no-warranty", "merchantability", 2, "(?:implied )?warrant(?:y|ies) of merchantability (?:and|or) fitness for a particular purpose"),
    ("no-liability", "liable", 2, "in no event shall the (?:authors?|copyright (?:holders?|owners?)|regents)(?: or (?:copyright holders|contributors))? be liable"),
    ("proprietary", "may be reproduced", 2, "no part of this (?:publication|document|work|book) may be reproduced .{0,120}?without (?:the )?(?:prior )?written permission"),
    ("proprietary", "trade secret", 2, "(?:contains|constitutes?) (?:confidential and )?(?:proprietary )?trade secrets? of"),
    ("proprietary", "end user", 2, "end user licen[sc]e agreement"),
    ("proprietary", "internal use", 2, "for internal use only"),
    ("non-commercial", "personal", 2, "for personal (?:and )?non ?commercial use(?: only)?"),
    ("non-commercial", "for academic", 2, "for academic (?:and (?:research|educational) )?(?:use|purposes) only"),
    ("non-commercial", "for research", 2, "for research (?:and (?:academic|educational) )?(?:use|purposes) only"),
    ("non-commercial", "for educational", 2, "for educational (?:and (?:research|academic) )?(?:use|purposes) only"),
    ("reprint-permission", "permission", 2, "(?:reprinted|reproduced|used) (?:with|by) (?:kind )?permission(?: (?:of|from))?"),
    ("copyleft", "copyleft", 3, "copyleft"),
    ("shareware", "shareware", 3, "(?:this is|distributed as) shareware"),
    ("freeware", "freeware", 3, "(?:this is|distributed as) freeware"),
]

WEIGHT = {1: 1.0, 2: 0.9, 3: 0.6}
BASE_WEIGHT = 0.5


def families() -> dict[str, list[tuple[str, int, str]]]:
    """(label, priority, expression) by keyword, in order."""
    out: dict[str, list[tuple[str, int, str]]] = {}
    for label, key, priority, pattern in NOTICES:
        out.setdefault(key, []).append((label, priority, f" {pattern}(?= )"))
    for label, key, name in NAMES:
        out.setdefault(key, []).extend((label, priority, f" {s % name}(?= )") for priority, s in STATEMENTS)
    return out


def word_form(text: Column) -> Column:
    """' word word ... word ', or ' ' without words."""
    plain = F.translate(text, UPPER + _SEPARATORS, LOWER + " " * len(_SEPARATORS))
    return F.concat(F.lit(" "), F.ltrim(F.regexp_replace(F.concat(plain, F.lit(" ")), " {2,}", " ")))


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def _places(form: Column, doubled: Column, n_words: Column, phrase: str) -> list[Column]:
    """Number of places, first and last start in words (null if none)."""
    inner = f" {phrase.replace(' ', '  ')} "
    there = form.contains(f" {phrase} ")
    parts = F.split(doubled, inner, -1)
    n = F.when(there, F.size(parts) - 1).otherwise(0)
    first = F.when(there, (_spaces(F.element_at(parts, 1)) - 1) / 2)
    last = F.when(there, n_words - (_spaces(F.element_at(parts, -1)) - 1) / 2 - len(phrase.split()))
    return [n.cast("long"), first.cast("long"), last.cast("long")]


_SPANS = "array<struct<start:int,end:int,priority:int,label:string>>"


def _tried(form: Column) -> Column:
    """What each rule finds, as (label, priority, found), of the rules whose keyword stands in the text."""
    out = []
    for key, of in families().items():
        rules = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(priority).alias("priority"), F.regexp_extract_all(form, F.lit(pattern), F.lit(0)).alias("found")) for label, priority, pattern in of])
        out.append(F.when(form.contains(key), F.filter(rules, lambda r: F.size(r["found"]) > 0)).otherwise(F.array().cast("array<struct<label:string,priority:int,found:array<string>>>")))
    return F.concat(*out)


def _matches(form: Column, rule: Column) -> Column:
    """All matches of a rule as (start, end, priority, label). A match begins with a space and a space follows it, so where its words
    stand first after the match before is its own place: the rule would match there."""
    kind = f"struct<at:int,out:{_SPANS}>"
    zero = F.struct(F.lit(1).alias("at"), F.array().alias("out")).cast(kind)

    def step(s: Column, m: Column) -> Column:
        start = F.position(F.concat(m, F.lit(" ")), form, s["at"])
        end = start + F.length(m)
        one = F.struct(start.alias("start"), (end - 1).alias("end"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out")).cast(kind)

    return F.aggregate(rule["found"], zero, step, lambda s: s["out"])


def _resolved(spans: Column) -> Column:
    """Without those that lie within another of the same or a higher priority. In order of start and falling end, what may
    contain a span stands before it, so the largest end so far of each priority decides."""
    kind = "struct<e1:int,e2:int,e3:int,out:array<struct<start:int,end:int,priority:int,label:string>>>"
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["priority"].alias("priority"), s["label"].alias("label"))))
    zero = F.struct(F.lit(0).alias("e1"), F.lit(0).alias("e2"), F.lit(0).alias("e3"), F.array().alias("out")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        end, p = -x["back"], x["priority"]
        reach = F.when(p == 1, s["e1"]).when(p == 2, F.greatest(s["e1"], s["e2"])).otherwise(F.greatest(s["e1"], s["e2"], s["e3"]))
        one = F.struct(x["start"].alias("start"), end.alias("end"), p.alias("priority"), x["label"].alias("label"))
        keep = lambda k: F.when(p == k, F.greatest(s[f"e{k}"], end)).otherwise(s[f"e{k}"]).alias(f"e{k}")
        return F.when(reach >= end, s).otherwise(F.struct(keep(1), keep(2), keep(3), F.concat(s["out"], F.array(one)).alias("out")).cast(kind))

    return F.aggregate(ordered, zero, step, lambda s: s["out"])


def license_detections(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, n_words, n_base, first_word, last_word, base_labels and labels (sorted arrays), score, and
    detections (start, end, priority, label; characters of the text's form) after resolution.

    A null or empty text has no words, labels or detections and score 0. Repeated rows are scanned each; an empty table
    gives no rows; other columns are ignored. score is that of the highest priority found: 1 notice, 0.9 statement, 0.6
    mention, 0.5 a base phrase alone.
    """
    form, doubled, n = F.col("form"), F.replace(F.col("form"), F.lit(" "), F.lit("  ")), F.col("n_words")
    rows = docs.select(F.col("doc_id").cast("long"), word_form(text_of()).alias("form")).withColumn("n_words", (_spaces(F.col("form")) - 1).cast("long"))
    spans = F.flatten(F.transform(_tried(form), lambda r: _matches(form, r)))
    places = [_places(form, doubled, n, phrase) for phrase, _ in BASE]
    marked = rows.select(
        "doc_id",
        "n_words",
        sum((p[0] for p in places[1:]), places[0][0]).alias("n_base"),
        F.least(*[p[1] for p in places]).alias("first_word"),
        F.greatest(*[p[2] for p in places]).alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[F.when(p[0] > 0, F.lit(label)) for p, (_, label) in zip(places, BASE, strict=True)]))).alias("base_labels"),
        spans.alias("spans"),
    )
    found = marked.withColumn("detections", F.when(F.size("spans") > 0, _resolved(F.col("spans"))).otherwise(F.col("spans"))).drop("spans")
    best = F.array_min(F.transform("detections", lambda s: s["priority"]))
    score = F.when(best == 1, F.lit(WEIGHT[1])).when(best == 2, F.lit(WEIGHT[2])).when(best == 3, F.lit(WEIGHT[3])).when(F.size("base_labels") > 0, F.lit(BASE_WEIGHT)).otherwise(F.lit(0.0))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("detections", lambda s: s["label"]))))
    return found.withColumn("labels", labels).withColumn("score", score)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_detections(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
