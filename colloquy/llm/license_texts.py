"""Hand-written signatures of license texts: sentences of the licenses themselves, headers, exceptions, ranges, dual licensing.

Fixed values, strongest first within a part. A space stands for any white space and the marks of wrapped comments. The
second field is a word, or words with bars between, of which every match holds one.
"""

from __future__ import annotations

#: Sentences that stand in one license only (or in its short family).
BODIES = (
    ("mit", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("mit", "permission", r"the above copyright notice and this permission notice \(?(?:including the next paragraph)?\)? ?shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction"),
    ("mit-modern", "permission", r"permission is hereby granted, without written agreement and without license or royalty fees, to use"),
    ("x11", "authorization", r"shall not be used in advertising or otherwise to promote the sale, use or other dealings in this software without prior written authorization"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("0bsd", "permission", r"permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted\. the software is provided"),
    ("hpnd", "permission", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose"),
    ("ntp", "permission", r"suitability of this software for any purpose\. it is provided as is without express or implied warranty, permission"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd-2-clause", "redistributions", r"redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution\. this software"),
    ("bsd-3-clause", "permission", r"may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause-clear", "patent", r"no express or implied licenses to any party's patent rights are granted by this license"),
    ("bsd-protection", "bsd", r"bsd protection license"),
    ("bsd-1-clause", "redistributions", r"redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer\. this software is provided"),
    ("apache-2", "contributor", r"each contributor hereby grants to you a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license"),
    ("apache-2", "license", r"you may obtain a copy of the license at https?://www\.apache\.org/licenses/license-2\.0"),
    ("apache-2", "license", r"license shall mean the terms and conditions for use, reproduction, and distribution as defined by sections 1 through 9"),
    ("apache-1.1", "apache", r"this product includes software developed by the apache (?:software foundation|group)"),
    ("apache-1", "apache", r"redistributions of any form whatsoever must retain the following acknowledgment: this product includes software developed by the apache group"),
    ("gpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu general public license"),
    ("gpl-2-or-later", "license", r"gnu general public license as published by the free software foundation; either version 2(?: of the license)?, or \(?at your option\)? any later version"),
    ("gpl-3-or-later", "license", r"gnu general public license as published by the free software foundation, either version 3(?: of the license)?, or \(?at your option\)? any later version"),
    ("gpl-2", "gnu", r"gnu general public license version 2, june 1991"),
    ("gpl-3", "gnu", r"gnu general public license version 3, 29 june 2007"),
    ("gpl-1", "gnu", r"gnu general public license version 1, february 1989"),
    ("gpl", "license", r"you should have received a copy of the gnu general public license along with this (?:program|software|library)"),
    ("gpl", "licenses", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-3", "license", r"the gnu general public license is a free, copyleft license for software and other kinds of works"),
    ("lgpl", "redistribute", r"you can redistribute it and/or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl-2.1-or-later", "license", r"gnu lesser general public license as published by the free software foundation; either version 2\.1(?: of the license)?, or \(?at your option\)? any later version"),
    ("lgpl-3-or-later", "license", r"gnu lesser general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(?at your option\)? any later version"),
    ("lgpl-2", "license", r"gnu library general public license version 2, june 1991"),
    ("lgpl-2.1", "license", r"gnu lesser general public license version 2\.1, february 1999"),
    ("lgpl-3", "license", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("lgpl", "license", r"you should have received a copy of the gnu (?:lesser|library) general public license along with this"),
    ("agpl-3-or-later", "affero", r"gnu affero general public license as published by the free software foundation[;,] either version 3(?: of the license)?, or \(?at your option\)? any later version"),
    ("agpl-3", "affero", r"gnu affero general public license version 3, 19 november 2007"),
    ("agpl", "affero", r"you should have received a copy of the gnu affero general public license along with this"),
    ("agpl-1", "affero", r"affero general public license version 1, march 2002"),
    ("gfdl", "license", r"permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", "license", r"with no invariant sections, no front-cover texts,? and no back-cover texts\. a copy of the license"),
    ("mpl-1.1", "license", r"the contents of this file are subject to the mozilla public license version 1\.1"),
    ("mpl-1", "license", r"the contents of this file are subject to the mozilla public license version 1\.0"),
    ("mpl-2", "license", r"this source code form is subject to the terms of the mozilla public license, v\. 2\.0"),
    ("mpl-2-no-copyleft-exception", "licenses", r"this source code form is incompatible with secondary licenses, as defined by the mozilla public license"),
    ("npl", "license", r"the contents of this file are subject to the netscape public license"),
    ("epl-1", "license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("epl-2", "license", r"made available under the terms of the eclipse public license 2\.0"),
    ("epl-1", "license", r"made available under the terms of the eclipse public license v1\.0"),
    ("edl-1", "license", r"eclipse distribution license - v ?1\.0"),
    ("cddl", "license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cpl", "license", r"the accompanying program is provided under the terms of this common public license"),
    ("ipl", "license", r"the accompanying program is provided under the terms of this ibm public license"),
    ("eupl", "eupl", r"licensed under the eupl, version 1\.[0-2] or - as soon they will be approved by the european commission"),
    ("eupl", "licence", r"this european union public licence \(?the eupl\)? applies to the work"),
    ("cecill", "cecill", r"this software is governed by the cecill(?:-[bc])? license under french law"),
    ("artistic-1", "copyright", r"the intent of this document is to state the conditions under which a package may be copied, such that the copyright holder maintains some semblance of artistic control"),
    ("artistic-2", "license", r"this license establishes the terms under which a given free software package may be copied, modified, distributed, and/or redistributed"),
    ("perl", "perl", r"(?:redistributed?|licensed?|distributed under license)[^.]{0,60}under the same terms as perl(?: itself)?"),
    ("zlib", "altered", r"altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("zlib", "permission", r"permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("libpng", "permission", r"permission is hereby granted to use, copy, modify, and distribute this source code, or portions hereof, for any purpose, without fee"),
    ("ijg", "jpeg", r"this software is based in part on the work of the independent jpeg group"),
    ("libtiff", "permission", r"permission to use, copy, modify, distribute, and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("boost", "obtaining", r"obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost", "license", r"distributed under the boost software license,? version 1\.0"),
    ("unlicense", "domain", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "anyone", r"anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "law", r"to the extent possible under law,? .{1,80} (?:has|have) waived all copyright and related or neighbou?ring rights"),
    ("cc0", "affirmer", r"affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives, abandons, and surrenders all of affirmer's copyright"),
    ("wtfpl", "just", r"you just do what the f\w+ you want to"),
    ("wtfpl", "permitted", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"),
    ("beerware", "stuff", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("python", "license", r"python software foundation license version 2"),
    ("python", "license", r"this license agreement is between the python software foundation"),
    ("cnri-python", "license", r"cnri (?:open source gpl-compatible )?license agreement"),
    ("postgresql", "permission", r"permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"),
    ("php", "php", r"this product includes php software, freely available from"),
    ("openssl", "openssl", r"this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("ssleay", "cryptographic", r"this product includes cryptographic software written by eric young"),
    ("curl", "copyright", r"copyright \(c\) [0-9 ,-]+ daniel stenberg"),
    ("ofl", "font", r"this font software is licensed under the sil open font license"),
    ("ofl", "font", r"the font software, including any derivative works, may be bundled, embedded, redistributed and/or sold with any software provided that any reserved names"),
    ("bitstream-vera", "font", r"permission is hereby granted, free of charge, to any person obtaining a copy of the fonts accompanying this license"),
    ("ufl", "font", r"ubuntu font licen[cs]e(?: version 1\.0)?"),
    ("gpl-font", "font", r"if you create a document which uses this font, and embed this font or unaltered portions of this font into the document"),
    ("unicode", "unicode", r"unicode, inc\.? license agreement - data files and software"),
    ("unicode", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of the unicode data files"),
    ("icu", "permission", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files .{1,400} provided that the above copyright notice\(s\) and this permission notice appear in all copies"),
    ("w3c", "permission", r"permission to copy, modify, and distribute this software and its documentation, with or without modification, for any purpose and without fee or royalty is hereby granted"),
    ("w3c-document", "permission", r"permission to copy, and distribute the contents of this document, or the w3c document from which this statement is linked"),
    ("ietf", "ietf", r"this document is subject to bcp 78 and the ietf trust's legal provisions relating to ietf documents"),
    ("ms-pl", "license", r"this license governs use of the accompanying software\. if you use the software, you accept this license"),
    ("apsl", "license", r"this file contains original code and/or modifications of original code as defined in and that are subject to the apple public source license"),
    ("apple-sample", "apple", r"in consideration of your agreement to the following terms, and your use, installation, modification or redistribution of this apple software"),
    ("ncsa", "permission", r"neither the names of .{1,120} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission\. the software"),
    ("qpl", "license", r"q public license version 1\.0"),
    ("sleepycat", "redistributions", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("vim", "vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", "permission", r"the authors hereby grant permission to use, copy, modify, distribute, and license this software and its documentation for any purpose"),
    ("ruby", "bsdl", r"you can redistribute it and/or modify it under either the terms of the 2-clause bsdl"),
    ("osl", "license", r"licensed under the open software license version [123]\.[0-9]"),
    ("afl", "license", r"licensed under the academic free license version [123]\.[0-9]"),
    ("ecl", "license", r"licensed under the educational community license,? version [12]\.0"),
    ("upl", "license", r"the universal permissive license \(?upl\)?,? version 1\.0"),
    ("mulan", "mulan", r"licensed under mulan (?:psl|publ) v[12]"),
    ("oclc", "license", r"oclc research public license 2\.0"),
    ("rpl", "license", r"reciprocal public license(?: 1\.[15])?"),
    ("cpal", "license", r"common public attribution license(?: version 1\.0)?"),
    ("watcom", "license", r"sybase open watcom public license"),
    ("intel", "license", r"intel simplified software license"),
    ("nvidia", "license", r"nvidia (?:software|source code|driver|deep learning container) license"),
    ("json", "evil", r"the software shall be used for good, not evil"),
    ("elastic", "managed", r"you may not provide the software to third parties as a hosted or managed service, where the service provides users with access"),
    ("sspl", "service", r"if you make the functionality of the program or a modified version available to third parties as a service, you must make the service source code available"),
    ("busl", "license", r"the business source license \(?this document, or the license\)? is not an open source license"),
    ("busl", "license", r"on the change date,? or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work under this license"),
    ("commons-clause", "license", r"the license does not grant to you, the right to sell the software"),
    ("commons-clause", "commons", r"commons clause license condition v?1\.0"),
    ("polyform-noncommercial", "polyform", r"polyform noncommercial license(?: 1\.0\.0)?"),
    ("polyform-small-business", "polyform", r"polyform small business license(?: 1\.0\.0)?"),
    ("polyform-shield", "polyform", r"polyform shield license(?: 1\.0\.0)?"),
    ("prosperity", "license", r"the prosperity public license(?: [23]\.0\.0)?"),
    ("parity", "license", r"the parity public license(?: [67]\.0\.0)?"),
    ("blueoak", "license", r"blue oak model license(?: 1\.0\.0)?"),
    ("hippocratic", "license", r"hippocratic license(?: (?:version )?[123]\.[01])?"),
    ("anti-996", "license", r"anti 996 license(?: version 1\.0)?"),
    ("confluent", "license", r"confluent community license(?: agreement)?(?: version 1\.0)?"),
    ("timescale", "license", r"timescale license agreement"),
    ("fsl", "license", r"functional source license,? version 1\.[01]"),
    ("cal", "license", r"cryptographic autonomy license(?: version 1\.0)?"),
)

#: Terms that change a license rather than name one.
EXCEPTIONS = (
    ("classpath-exception", "exception", r"(?:as a special exception|classpath exception)[^.]{0,120}(?:permission to link this library with independent modules|license)"),
    ("gcc-exception", "exception", r"gcc runtime library exception"),
    ("bison-exception", "bison", r"as a special exception, you may create a larger work that contains part or all of the bison parser skeleton and distribute"),
    ("autoconf-exception", "exception", r"as a special exception to the gnu general public license, if you distribute this file as part of a program that contains a configuration script generated by autoconf"),
    ("libtool-exception", "exception", r"as a special exception to the gnu general public license, if you distribute this file as part of a program or library that is built using gnu libtool"),
    ("openssl-exception", "openssl", r"permission to link the code of portions of this program with the openssl library"),
    ("font-exception", "font", r"font embedding exception to the (?:gnu )?(?:general public license|gpl)"),
    ("linking-exception", "link", r"permission to link this (?:library|software) with independent modules to produce an executable"),
    ("llvm-exception", "llvm", r"llvm exceptions? to the apache 2\.0 license"),
    ("llvm-exception", "llvm", r"apache license v2\.0 with llvm exceptions"),
    ("universal-foss-exception", "exception", r"universal foss exception,? version 1\.0"),
    ("linux-syscall-note", "copyright", r"this copyright does not cover user programs that use kernel services by normal system calls"),
    ("wxwindows-exception", "wxwindows", r"wxwindows library licen[cs]e(?:,? version 3\.1)?"),
    ("qt-exception", "exception", r"qt gpl exception(?: version)? 1\.0"),
    ("swift-exception", "exception", r"licensed under apache license v2\.0 with runtime library exception"),
)

#: Dual licensing, ranges of versions, and where the terms are to be found.
NOTICES = (
    ("mit|apache-2", "license", r"licensed under either of (?:the )?apache license,? version 2\.0[^.]{0,80}or (?:the )?mit license"),
    ("mit|apache-2", "licensed", r"dual[- ]licensed under (?:the )?(?:mit and apache(?:-| )2\.0|apache(?:-| )2\.0 and mit)"),
    ("mit|gpl", "licensed", r"dual[- ]licensed under (?:the )?(?:mit (?:and|or) gpl|gpl (?:and|or) mit)"),
    ("mpl-1.1|gpl|lgpl", "mpl", r"version: mpl 1\.1/gpl 2\.0/lgpl 2\.1"),
    ("mpl-1.1|gpl|lgpl", "license", r"alternatively, the contents of this file may be used under the terms of either the gnu general public license version 2 or later"),
    ("gpl|commercial", "commercial", r"available under (?:the )?(?:gnu )?(?:gpl|general public license) or (?:under )?a commercial license"),
    ("gpl-2-or-later", "gpl", r"licen[cs]ed? (?:under )?(?:the )?(?:gnu )?gpl ?v?2(?:\.0)? or (?:later|newer|above)"),
    ("gpl-3-or-later", "gpl", r"licen[cs]ed? (?:under )?(?:the )?(?:gnu )?gpl ?v?3(?:\.0)? or (?:later|newer|above)"),
    ("gpl-2", "gpl", r"licensed under (?:the )?gpl ?-?v?2(?:\.0)?(?: only)?"),
    ("gpl-3", "gpl", r"licensed under (?:the )?gpl ?-?v?3(?:\.0)?(?: only)?"),
    ("lgpl-2.1", "lgpl", r"licensed under (?:the )?lgpl ?-?v?2\.1"),
    ("lgpl-3", "lgpl", r"licensed under (?:the )?lgpl ?-?v?3(?:\.0)?"),
    ("agpl-3", "agpl", r"licensed under (?:the )?agpl ?-?v?3(?:\.0)?"),
    ("mpl-2", "mpl", r"licensed under (?:the )?mpl ?-?v?2(?:\.0)?"),
    ("bsd", "bsd", r"use of this source code is governed by a bsd-style license that can be found in the license file"),
    ("mit", "mit", r"use of this source code is governed by an mit-style license that can be found in the license file"),
    ("apache-2", "apache", r"use of this source code is governed by the apache 2\.0 license"),
    ("custom-file", "licen", r"see (?:the )?(?:accompanying )?(?:file )?(?:license|copying)(?:\.(?:txt|md|rst))? (?:file )?for (?:the )?(?:full )?(?:licen[cs]e|licensing)"),
    ("custom-file", "copying", r"see the file copying(?:\.txt)? for copying permission"),
    ("linux-gpl-2", "gpl", r"module_license ?\( ?[\"']gpl(?: v2)?[\"'] ?\)"),
    ("mit", "osi", r"license :: osi approved :: mit license"),
    ("apache-2", "osi", r"license :: osi approved :: apache software license"),
    ("bsd", "osi", r"license :: osi approved :: bsd license"),
    ("gpl-3", "osi", r"license :: osi approved :: gnu general public license v3(?: or later)?"),
    ("gpl-2", "osi", r"license :: osi approved :: gnu general public license v2(?: or later)?"),
    ("lgpl", "osi", r"license :: osi approved :: gnu lesser general public license v[23](?: or later)?"),
    ("mpl-2", "osi", r"license :: osi approved :: mozilla public license 2\.0"),
    ("isc", "osi", r"license :: osi approved :: isc license"),
    ("python", "osi", r"license :: osi approved :: python software foundation license"),
    ("proprietary", "proprietary", r"license :: other/proprietary license"),
)

#: Licenses of texts, data and models.
CONTENT = (
    ("cc-by", "creative", r"this work is licensed under (?:a|the) creative commons attribution (?:[1-4]\.[05] )?(?:international|unported|generic)? ?license"),
    ("cc-by-sa", "creative", r"this work is licensed under (?:a|the) creative commons attribution-share ?alike (?:[1-4]\.[05] )?(?:international|unported|generic)? ?license"),
    ("cc-by-nd", "creative", r"this work is licensed under (?:a|the) creative commons attribution-no ?deriv(?:s|atives|ative works) (?:[1-4]\.[05] )?(?:international|unported|generic)? ?license"),
    ("cc-by-nc", "creative", r"this work is licensed under (?:a|the) creative commons attribution-non ?commercial (?:[1-4]\.[05] )?(?:international|unported|generic)? ?license"),
    ("cc-by-nc-sa", "creative", r"this work is licensed under (?:a|the) creative commons attribution-non ?commercial-share ?alike (?:[1-4]\.[05] )?(?:international|unported|generic)? ?license"),
    ("cc-by-nc-nd", "creative", r"this work is licensed under (?:a|the) creative commons attribution-non ?commercial-no ?deriv(?:s|atives|ative works) (?:[1-4]\.[05] )?(?:international|unported|generic)? ?license"),
    ("cc-by", "creativecommons", r"https?://creativecommons\.org/licenses/by/[1-4]\.[05]"),
    ("cc-by-sa", "creativecommons", r"https?://creativecommons\.org/licenses/by-sa/[1-4]\.[05]"),
    ("cc-by-nd", "creativecommons", r"https?://creativecommons\.org/licenses/by-nd/[1-4]\.[05]"),
    ("cc-by-nc", "creativecommons", r"https?://creativecommons\.org/licenses/by-nc/[1-4]\.[05]"),
    ("cc-by-nc-sa", "creativecommons", r"https?://creativecommons\.org/licenses/by-nc-sa/[1-4]\.[05]"),
    ("cc-by-nc-nd", "creativecommons", r"https?://creativecommons\.org/licenses/by-nc-nd/[1-4]\.[05]"),
    ("cc-by-sa", "share", r"text is available under the creative commons attribution-share ?alike license"),
    ("odbl", "database", r"this .{1,60} is made available under the open database license"),
    ("odc-by", "commons", r"this .{1,60} is made available under the open data commons attribution license"),
    ("pddl", "domain", r"this .{1,60} is made available under the public domain dedication and license"),
    ("ogl-uk", "government", r"contains public sector information licensed under the open government licen[cs]e(?: v[123]\.0)?"),
    ("ogl-uk", "government", r"open government licen[cs]e(?: v(?:ersion )?[123]\.0)?"),
    ("etalab", "licence", r"licence ouverte(?: / open licence)?(?: version)?(?: [12]\.0)?"),
    ("dl-de", "datenlizenz", r"datenlizenz deutschland (?:- )?(?:namensnennung|zero) ?(?:- )?(?:version )?(?:2\.0)?"),
    ("cdla-permissive", "community", r"community data license agreement (?:- )?permissive(?:,? version [12]\.0)?"),
    ("cdla-sharing", "community", r"community data license agreement (?:- )?sharing(?:,? version 1\.0)?"),
    ("gutenberg", "gutenberg", r"project gutenberg(?:-tm)? license"),
    ("dsl", "design", r"design science license"),
    ("fal", "art", r"free art license(?: 1\.[0-3])?"),
    ("openrail", "rail", r"creativeml open rail\+?\+?-m license"),
    ("bigscience-rail", "rail", r"bigscience (?:open)?rail(?:-m)? license"),
    ("llama-community", "llama", r"llama (?:[23](?:\.[0-9])? )?community license(?: agreement)?"),
    ("gemma", "gemma", r"gemma terms of use[^.]{0,80}licen[cs]e"),
    ("research-only", "research", r"licensed for (?:non-?commercial )?research (?:purposes|use) only"),
    ("non-commercial", "commercial", r"licensed for (?:personal(?: and|,)? )?non-?commercial use only"),
)

#: Rights kept or given away without a named license.
RIGHTS = (
    ("public-domain", "domain", r"(?:released|placed|dedicated|put) (?:in)?to the public domain", 0.8),
    ("public-domain", "domain", r"this (?:file|work|code|program|software|document) is (?:hereby )?(?:in|part of) the public domain", 0.8),
    ("public-domain", "copyright", r"the authors? disclaims? (?:all )?copyright to this source code", 0.9),
    ("public-domain", "copyright", r"no copyright is claimed", 0.7),
    ("us-government-work", "copyright", r"not subject to copyright protection (?:within|in) the united states", 0.8),
    ("proprietary", "confidential", r"proprietary and confidential", 0.8),
    ("proprietary", "unauthorized", r"unauthorized (?:copying|use|reproduction|distribution|redistribution) of this (?:file|software|document|material)[^.]{0,80}(?:permission|licen[cs]e|copyright|prohibited)", 0.8),
    ("proprietary", "permission", r"no part of this (?:publication|book|document|work|software) may be reproduced[^.]{0,160}without (?:the )?(?:prior )?(?:written )?permission", 0.8),
    ("proprietary", "permission", r"(?:may|must) not be (?:copied|reproduced|distributed|redistributed) without (?:the )?(?:express )?(?:prior )?(?:written )?permission", 0.7),
    ("proprietary", "license", r"this software is licensed,? not sold", 0.8),
    ("proprietary", "license", r"end[- ]user license agreement", 0.7),
    ("proprietary", "licen", r"subject to the terms of a (?:commercial|proprietary) licen[cs]e", 0.7),
    ("proprietary", "reserved", r"all rights reserved", 0.5),
)
