"""Ordered signature rules for licences, written for texts cut into words that are joined by single spaces.

A licence has a label, a name as a regular expression, and its SPDX identifier in words. Four forms are built for each
(tag, grant, full name with the word licence, link), and whole sentences of licence texts are listed by hand.
Lower priority numbers are stronger.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    number: int
    label: str
    priority: int
    keyword: str
    words: tuple[str, ...]
    pattern: str


#: By the start of a label, words of which the name of such a licence has one at least.
_NAME_WORDS = {
    "mit": ("mit", "expat", "x11"), "apache": ("apache",), "gpl": ("gpl", "general"), "lgpl": ("lgpl", "general"), "agpl": ("agpl", "affero"),
    "gfdl": ("gfdl", "documentation"), "bsd": ("bsd",), "0bsd": ("bsd",), "isc": ("isc",), "mpl": ("mpl", "mozilla"), "epl": ("epl", "eclipse"),
    "cddl": ("cddl", "development"), "cpl": ("cpl", "common"), "eupl": ("eupl", "european"), "artistic": ("artistic",), "bsl": ("boost",), "busl": ("business",),
    "zlib": ("zlib",), "libpng": ("libpng",), "unlicense": ("unlicense",), "wtfpl": ("wtfpl", "fuck"), "python": ("psf", "python"), "php": ("php",), "ruby": ("ruby",),
    "postgresql": ("postgresql",), "openssl": ("openssl",), "ofl": ("font",), "ms": ("microsoft",), "ncsa": ("ncsa",), "upl": ("permissive",), "sspl": ("server",),
    "elastic": ("elastic",), "odbl": ("odbl", "database"), "pddl": ("pddl", "dedication"), "odc": ("odc", "commons"), "openrail": ("rail", "responsible"),
    "cecill": ("cecill",), "afl": ("academic",), "osl": ("software",), "proprietary": ("proprietary", "commercial", "user"),
}
# label, name, SPDX identifier in words, place in a link
_LICENSES = (
    ("mit", r"(?:mit|expat|x11)", "mit", "opensource org licenses mit"),
    ("mit-0", r"mit (?:no attribution|0)", "mit 0", ""),
    ("apache-2.0", r"apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache 2 0", "apache org licenses license 2 0"),
    ("apache-1.1", r"apache(?: software)?(?: license)?(?: version| v)? ?1 1", "apache 1 1", "apache org licenses license 1 1"),
    ("apache-1.0", r"apache(?: software)?(?: license)?(?: version| v)? ?1 0", "apache 1 0", "apache org licenses license 1 0"),
    ("gpl-1.0", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?1(?: 0)?", "gpl 1 0", "gnu org licenses gpl 1 0"),
    ("gpl-2.0", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?2(?: 0)?", "gpl 2 0", "gnu org licenses gpl 2 0"),
    ("gpl-3.0", r"(?:gnu )?(?:gpl|general public license)(?: version| v)? ?3(?: 0)?", "gpl 3 0", "gnu org licenses gpl 3 0"),
    ("lgpl-2.0", r"(?:gnu )?(?:lgpl|library general public license)(?: version| v)? ?2(?: 0)?", "lgpl 2 0", "gnu org licenses lgpl 2 0"),
    ("lgpl-2.1", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?2 1", "lgpl 2 1", "gnu org licenses lgpl 2 1"),
    ("lgpl-3.0", r"(?:gnu )?(?:lgpl|lesser general public license)(?: version| v)? ?3(?: 0)?", "lgpl 3 0", "gnu org licenses lgpl 3 0"),
    ("agpl-3.0", r"(?:gnu )?(?:agpl|affero general public license)(?: version| v)? ?3(?: 0)?", "agpl 3 0", "gnu org licenses agpl 3 0"),
    ("gfdl-1.2", r"(?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1 2", "gfdl 1 2", "gnu org licenses fdl 1 2"),
    ("gfdl-1.3", r"(?:gnu )?(?:gfdl|free documentation license)(?: version| v)? ?1 3", "gfdl 1 3", "gnu org licenses fdl 1 3"),
    ("bsd-2-clause", r"(?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd|freebsd)", "bsd 2 clause", "opensource org licenses bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|modified bsd|revised bsd)", "bsd 3 clause", "opensource org licenses bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd 4 clause|4 clause bsd|original bsd|old bsd)", "bsd 4 clause", ""),
    ("0bsd", r"(?:0bsd|zero clause bsd|bsd zero clause)", "0bsd", "opensource org licenses 0bsd"),
    ("isc", r"isc", "isc", "opensource org licenses isc"),
    ("mpl-1.0", r"(?:mpl|mozilla public license)(?: version| v)? ?1 0", "mpl 1 0", ""),
    ("mpl-1.1", r"(?:mpl|mozilla public license)(?: version| v)? ?1 1", "mpl 1 1", "mozilla org mpl 1 1"),
    ("mpl-2.0", r"(?:mpl|mozilla public license)(?: version| v)? ?2(?: 0)?", "mpl 2 0", "mozilla org mpl 2 0"),
    ("epl-1.0", r"(?:epl|eclipse public license)(?: version| v)? ?1(?: 0)?", "epl 1 0", "eclipse org legal epl v10"),
    ("epl-2.0", r"(?:epl|eclipse public license)(?: version| v)? ?2(?: 0)?", "epl 2 0", "eclipse org legal epl 2 0"),
    ("cddl-1.0", r"(?:cddl|common development and distribution license)(?: version| v)?(?: 1 0)?", "cddl 1 0", "opensource org licenses cddl 1 0"),
    ("cpl-1.0", r"(?:cpl|common public license)(?: version| v)?(?: 1 0)?", "cpl 1 0", ""),
    ("eupl-1.1", r"(?:eupl|european union public licen[cs]e)(?: version| v)? ?1 1", "eupl 1 1", ""),
    ("eupl-1.2", r"(?:eupl|european union public licen[cs]e)(?: version| v)? ?1 2", "eupl 1 2", ""),
    ("artistic-1.0", r"artistic(?: license)?(?: version| v)? ?1 0", "artistic 1 0", ""),
    ("artistic-2.0", r"artistic(?: license)?(?: version| v)? ?2(?: 0)?", "artistic 2 0", "opensource org licenses artistic license 2 0"),
    ("bsl-1.0", r"boost software(?: license)?(?: version| v)?(?: 1 0)?", "bsl 1 0", "boost org license 1 0"),
    ("busl-1.1", r"business source(?: license)?(?: version| v)?(?: 1 1)?", "busl 1 1", "mariadb com bsl11"),
    ("zlib", r"(?:zlib|zlib libpng)", "zlib", "zlib net zlib license"),
    ("libpng", r"libpng", "libpng", ""),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "unlicense org"),
    ("wtfpl", r"(?:wtfpl|do what the fuck you want to public)", "wtfpl", "wtfpl net"),
    ("python-2.0", r"(?:psf|python software foundation)(?: license)?(?: version| v)?(?: 2(?: 0)?)?", "python 2 0", ""),
    ("php-3.01", r"php(?: license)?(?: version| v)? ?3 01", "php 3 01", "php net license 3 01"),
    ("ruby", r"ruby", "ruby", ""),
    ("postgresql", r"postgresql", "postgresql", "opensource org licenses postgresql"),
    ("openssl", r"openssl", "openssl", ""),
    ("ofl-1.1", r"(?:sil )?open font(?: license)?(?: version| v)?(?: 1 1)?", "ofl 1 1", "scripts sil org ofl"),
    ("ms-pl", r"microsoft public", "ms pl", "opensource org licenses ms pl"),
    ("ms-rl", r"microsoft reciprocal", "ms rl", "opensource org licenses ms rl"),
    ("ncsa", r"(?:ncsa|university of illinois ncsa open source)", "ncsa", ""),
    ("upl-1.0", r"universal permissive(?: license)?(?: version| v)?(?: 1 0)?", "upl 1 0", ""),
    ("sspl-1.0", r"server side public(?: license)?(?: version| v)?(?: 1(?: 0)?)?", "sspl 1 0", ""),
    ("elastic-2.0", r"elastic(?: license)?(?: version| v)? ?2(?: 0)?", "elastic 2 0", ""),
    ("odbl-1.0", r"(?:odbl|open database)(?: license)?(?: version| v)?(?: 1 0)?", "odbl 1 0", "opendatacommons org licenses odbl"),
    ("pddl-1.0", r"(?:pddl|public domain dedication and license)", "pddl 1 0", "opendatacommons org licenses pddl"),
    ("odc-by-1.0", r"(?:odc by|open data commons attribution)", "odc by 1 0", "opendatacommons org licenses by"),
    ("openrail-m", r"(?:openrail m?|open rail m?|responsible ai)", "openrail m", ""),
    ("cecill-2.1", r"cecill(?: version| v)?(?: 2 1)?", "cecill 2 1", "cecill info"),
    ("afl-3.0", r"academic free(?: license)?(?: version| v)?(?: 3 0)?", "afl 3 0", ""),
    ("osl-3.0", r"open software(?: license)?(?: version| v)?(?: 3 0)?", "osl 3 0", ""),
    ("proprietary", r"(?:proprietary|commercial|end user)", "licenseref proprietary", ""),
)
# label, clauses of a Creative Commons licence in letters and in words
_COMMONS = (
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"),
    ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by", "by", "attribution"),
)
# label, priority, keyword, sentence
_SENTENCES = (
    ("mit", 2, "copyright", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 3, "warrant", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("mit", 3, "copyright", "in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit-modern", 2, "permission", "permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software"),
    ("x11", 2, "copyright", "except as contained in this notice the names? of the (?:above )?copyright holders? shall not be used in advertising"),
    ("x11", 2, "permission", "permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("hpnd", 2, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted"),
    ("ntp", 2, "permission", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("isc", 3, "warrant", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", 1, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd-2-clause", 2, "redistribut", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-2-clause", 2, "redistribut", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd-3-clause", 2, "permission", "neither the names? of (?:the )?[^ ]+(?: [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 2, "copyright", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment(?: [^ ]+){0,40} copyright"),
    ("bsd-3-clause-clear", 2, "licen", "no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd", 3, "copyright", "in no event shall the copyright (?:holder|owner)s? or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("apache-2.0", 2, "licen", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("apache-2.0", 2, "licen", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 2, "licen", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license"),
    ("apache-2.0", 2, "licen", "licensed to the apache software foundation asf under one or more contributor license agreements"),
    ("apache-1.1", 2, "permission", "the names apache(?: [^ ]+){0,8} must not be used to endorse or promote products derived from this software without prior written permission"),
    ("gpl", 2, "warrant", "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license"),
    ("gpl", 2, "licen", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", 3, "licen", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", 3, "licen", "the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0-only", 1, "licen", "under the terms of (?:the )?gnu general public license version 2 only"),
    ("gpl-2.0-only", 2, "licen", "under the terms of the gnu general public license version 2 as published by the free software foundation"),
    ("gpl-3.0", 3, "licen", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", 3, "licen", "you may convey a work based on the program or the modifications to produce it from the program(?: [^ ]+){0,20} license"),
    ("gpl-exception-classpath", 1, "permission", "as a special exception the copyright holders of this library give you permission to link this library with independent modules"),
    ("gpl-exception-linking", 2, "permission", "in addition as a special exception(?: [^ ]+){0,8} gives? permission to link (?:the )?code"),
    ("gcc-exception-3.1", 1, "permission", "under section 7 of gpl version 3 you are granted additional permissions described in the gcc runtime library exception"),
    ("bison-exception", 2, "licen", "you may create a larger work that contains part or all of the bison parser skeleton(?: [^ ]+){0,20} license"),
    ("lgpl-2.1", 2, "licen", "either version 2 1 of the license or at your option any later version"),
    ("lgpl", 2, "licen", "you should have received a copy of the gnu (?:lesser|library) general public license along with this (?:library|program)"),
    ("lgpl-3.0", 3, "licen", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0", 2, "licen", "you should have received a copy of the gnu affero general public license along with this program"),
    ("agpl-3.0", 3, "licen", "remote network interaction use with the gnu general public license"),
    ("gfdl", 1, "permission", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", 2, "licen", "with no invariant sections no front cover texts and no back cover texts a copy of the license is included"),
    ("mpl-2.0", 2, "licen", "if a copy of the mpl was not distributed with this file you can obtain one at(?: [^ ]+){0,12} license"),
    ("mpl-2.0", 3, "licen", "this source code form is incompatible with secondary licenses as defined by the mozilla public license"),
    ("mpl-1.1", 1, "licen", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-1.0", 1, "licen", "the contents of this file are subject to the mozilla public license version 1 0"),
    ("npl-1.1", 1, "licen", "the contents of this file are subject to the netscape public license version 1 1"),
    ("mpl-tri-license", 1, "licen", "alternatively the contents of this file may be used under the terms of either the gnu general public license version 2 or later"),
    ("epl-2.0", 1, "licen", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("epl-1.0", 1, "licen", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl", 3, "licen", "any use reproduction or distribution of the program constitutes recipient s acceptance of this(?: [^ ]+){0,3} license"),
    ("cddl-1.0", 1, "licen", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl-1.0", 2, "licen", "you can obtain a copy of the license at usr src opensolaris license"),
    ("cpl-1.0", 2, "licen", "the accompanying program is provided under the terms of this common public license"),
    ("epl-1.0", 2, "licen", "the accompanying program is provided under the terms of this eclipse public license"),
    ("eupl-1.2", 1, "licen", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("artistic-2.0", 2, "licen", "this is free software you can redistribute it and or modify it under the terms of the artistic license 2 0"),
    ("artistic-perl", 1, "licen", "under the same terms as perl itself(?: [^ ]+){0,12} license"),
    ("artistic-perl", 2, "licen", "either the gnu general public license(?: [^ ]+){0,20} or the artistic license"),
    ("bsl-1.0", 2, "licen", "distributed under the boost software license version 1 0"),
    ("busl-1.1", 1, "licen", "use of this software is governed by the business source license"),
    ("busl-1.1", 2, "licen", "change license(?: [^ ]+){0,12} the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use"),
    ("zlib", 2, "permission", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", 3, "redistribut", "this notice may not be removed or altered from any source (?:re)?distribution(?: [^ ]+){0,4} redistribut[^ ]*"),
    ("unlicense", 2, "domain", "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"),
    ("wtfpl", 1, "licen", "do what the fuck you want to public licen[cs]e"),
    ("beerware", 1, "licen", "the beer ?ware license"),
    ("cc0-1.0", 1, "domain", "creative commons (?:cc0|cc zero)(?: [^ ]+){0,6} public domain(?: dedication)?"),
    ("cc0-1.0", 2, "domain", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc", 2, "licen", "this work is licensed under a creative commons [^ ]+(?: [^ ]+){0,8} licen[cs]e"),
    ("cc", 3, "licen", "you are free to share copy and redistribute the material in any medium or format(?: [^ ]+){0,60} licen[cs]e"),
    ("ofl-1.1", 1, "licen", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 2, "copyright", "copyright(?: [^ ]+){1,16} with reserved font name"),
    ("python-2.0", 2, "licen", "this license agreement is between the python software foundation psf and the individual or organization"),
    ("php-3.01", 2, "licen", "this source file is subject to version 3 0?1 of the php license"),
    ("openssl", 2, "redistribut", "this product includes software developed by the openssl project(?: [^ ]+){0,30} redistribut[^ ]*"),
    ("curl", 2, "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("libtiff", 2, "permission", "the names of sam leffler and silicon graphics may not be used(?: [^ ]+){0,20} permission"),
    ("ncsa", 2, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction"),
    ("json", 2, "licen", "the software shall be used for good not evil(?: [^ ]+){0,30} licen[cs]e"),
    ("sleepycat", 2, "redistribut", "redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("sspl-1.0", 2, "licen", "server side public license as published by mongodb"),
    ("elastic-2.0", 2, "licen", "you may not provide the software to third parties as a hosted or managed service(?: [^ ]+){0,40} licen[cs]e"),
    ("commons-clause", 1, "licen", "the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", 2, "licen", "polyform noncommercial license"),
    ("odbl-1.0", 2, "licen", "this [^ ]+(?: [^ ]+){0,4} is made available under the open database license"),
    ("odc-by-1.0", 2, "licen", "made available under the open data commons attribution license"),
    ("llama-community", 2, "licen", "licensed under the llama [^ ]+(?: [^ ]+)? community license"),
    ("openrail", 2, "licen", "use restrictions(?: [^ ]+){0,30} responsible ai licen[cs]e"),
    ("ecl-2.0", 1, "licen", "licensed under the educational community license version 2 0"),
    ("ms-pl", 2, "licen", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("vim", 2, "licen", "there are no restrictions on distributing unmodified copies of vim(?: [^ ]+){0,12} licen[cs]e"),
    ("ijg", 2, "copyright", "this software is based in part on the work of the independent jpeg group(?: [^ ]+){0,12} copyright"),
    ("oracle-bcl", 2, "licen", "oracle binary code license agreement"),
    ("unicode", 2, "copyright", "unicode copyright and terms of use|copyright(?: [^ ]+){0,6} unicode inc all rights reserved"),
    ("w3c", 2, "licen", "w3c software (?:and document )?(?:notice and )?license"),
    ("proprietary", 2, "copyright", "unauthori[sz]ed (?:copying|reproduction|distribution|use) of this (?:file|software|document|work)(?: [^ ]+){0,16} copyright"),
    ("proprietary", 2, "copyright", "(?:confidential and proprietary|proprietary and confidential)(?: [^ ]+){0,16} copyright"),
    ("proprietary", 3, "permission", "no part of this (?:publication|book|document|work) may be reproduced(?: [^ ]+){0,40} permission"),
    ("proprietary", 3, "licen", "this is a legal agreement between you(?: [^ ]+){0,20} licen[cs]e"),
    ("proprietary", 3, "licen", "for (?:personal|internal|evaluation|academic|research) use only(?: [^ ]+){0,20} licen[cs]e"),
    ("noncommercial", 3, "licen", "(?:for|strictly) non ?commercial (?:use|purposes)(?: only)?(?: [^ ]+){0,20} licen[cs]e"),
    ("dual", 3, "licen", "dual ?licen[cs]ed"),
    ("warranty", 4, "warrant", "disclaims? all warrant(?:y|ies)"),
    ("unknown", 4, "licen", "licen[cs]e agreement"),
    ("mit", 1, "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 2, "licen", "(?:released|distributed|available|provided|published) under (?:the )?(?:terms of the )?mit licen[cs]e"),
    ("isc", 1, "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", 1, "redistribut", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 2, "copyright", "this software is provided by the copyright holders and contributors as is"),
    ("apache-2.0", 1, "licen", "licensed under the apache license version 2 0 the license"),
    ("apache", 2, "licen", "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?apache licen[cs]e"),
    ("apache", 3, "licen", "you may not use this file except in compliance with the license"),
    ("gpl", 1, "licen", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 2, "licen", "(?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[cs]e"),
    ("gpl-2.0-or-later", 1, "licen", "either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 1, "licen", "either version 3 of the license or at your option any later version"),
    ("lgpl", 2, "licen", "(?:gnu )?(?:lesser|library) general public licen[cs]e"),
    ("agpl", 2, "licen", "(?:gnu )?affero general public licen[cs]e"),
    ("mpl-2.0", 1, "licen", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("bsl-1.0", 1, "permission", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("zlib", 1, "warrant", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("unlicense", 1, "domain", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", 1, " cc ", "cc 0(?: 1 0)?(?: universal)?"),
    ("cc0-1.0", 1, "licen", "spdx license identifier cc0(?: 1 0)?"),
    ("cc0-1.0", 2, "creativecommons", "creativecommons org publicdomain zero 1 0"),
    ("public-domain", 2, "domain", "(?:released|placed|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 3, "domain", "this (?:work|file|text|software) is in the public domain"),
    ("copyleft", 3, "copyleft", "copyleft"),
    ("proprietary", 3, "reserved", "all rights reserved"),
    ("proprietary", 3, "permission", "may not be (?:reproduced|copied|distributed|used) without (?:the )?(?:prior )?(?:written )?permission"),
    ("proprietary", 3, "licen", "subject to (?:the )?terms of (?:this|the) (?:license|licence) agreement"),
    ("copyright", 4, "copyright", "copyright (?:c )?(?:19|20)[0-9]{2}"),
    ("copyright", 4, "copyright", "copyright (?:c )?by"),
    ("warranty", 4, "warrant", "without (?:any )?warrant(?:y|ies) of any kind"),
    ("unknown", 4, "licen", "licen[cs]ed under(?: the)?(?: terms of)?"),
    ("unknown", 4, "licen", "see (?:the )?licen[cs]e(?: file)?(?: for details)?"),
    ("unknown", 4, "spdx", "spdx license identifier"),
    ("unknown", 4, "gnu", "gnu licen[cs]e"),
)


def _forms(name: str, words: tuple[str, ...]):
    """(keyword, pattern) for a name that holds "license" in part only: for each alternative, what all its matches hold."""
    choice = re.search(r"\(\?:([^()]*\|[^()]*)\)(?!\?)", name)
    for one in choice[1].split("|") if choice else [re.sub(r"\(\?:[^()]*\)\?", "", name)]:
        keyword = "licen" if "license" in one else next(w for w in words if w in one)
        yield keyword, name[: choice.start()] + one + name[choice.end() :] if choice else name


def _literal(pattern: str, keyword: str) -> str:
    """The longest text that every match of pattern holds as it stands, or keyword if there is none that is longer."""
    found, run, depth, i = [keyword], "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "|" and not depth:
            return keyword
        if c in "([":
            shut, level = i, 0
            while True:  # groups may hold groups, classes hold no brackets
                level += (pattern[shut] in "([") - (pattern[shut] in ")]")
                if not level:
                    break
                shut += 1
            found.append(run)
            run, i = "", shut
        elif c in "?*+{":
            found.append(run[:-1])
            run, i = "", pattern.index("}", i) if c == "{" else i
        elif c in ".\\^$":
            raise ValueError(f"{c} in {pattern}")
        else:
            run += c
        i += 1
    return max([*found, run], key=len)


def _built():
    for label, name, spdx, link in _LICENSES:
        words = _NAME_WORDS[label.split("-")[0]]
        yield label, 1, "spdx", (spdx,), f"spdx license identifier {spdx}(?: (?:only|or later))?"
        yield label, 2, " under ", words, f"(?:licen[cs]ed|released|distributed|available|published) under (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?"
        if "license" not in name:
            yield label, 3, "licen", words, f"{name} licen[cs]e"
        else:
            for keyword, pattern in _forms(name, words):
                yield label, 3, keyword, (_literal(pattern, keyword),), pattern
        if link:
            yield label, 1, "licen" if "licen" in link else link, (link,), link
    for label, letters, words in _COMMONS:
        for version in ("4 0", "3 0", "2 5", "2 0"):
            full = f"{label}-{version.replace(' ', '.')}"
            yield full, 1, " cc ", (f" {letters} {version} ",), f"(?:licen[cs]ed under (?:the )?)?cc {letters} {version}(?: international| unported| generic)?(?: licen[cs]e)?"
            yield full, 2, "creative commons", ("creative commons",), f"creative commons {words} {version}(?: international| unported| generic)?(?: licen[cs]e)?"
            yield full, 1, "creativecommons", (f"{letters} {version}",), f"creativecommons org licenses {letters} {version}"
    for label, priority, keyword, pattern in _SENTENCES:
        yield label, priority, keyword, (_literal(pattern, keyword),), pattern


#: A rule is tried on texts that hold its keyword and one of its words; every match of its pattern holds both.
RULES = tuple(Rule(i, *r) for i, r in enumerate(sorted(dict.fromkeys(_built()), key=lambda r: r[1])))
#: What a rule's keyword looks like in a raw text, where anything may stand between two words: its longest word, or a
#: regular expression for what all rules of the keyword have there.
KEYWORDS = {r.keyword: max(r.keyword.split(), key=len) for r in RULES} | {" cc ": "cc[^a-z0-9]", " under ": "(?:licen[cs]ed|released|distributed|available|published)[^a-z0-9]+under"}
#: Base phrases and their labels; their places are counted apart and never suppressed.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: A document's score is that of its strongest surviving rule, by priority; base phrases count as BASE_SCORE.
SCORES, BASE_SCORE = {1: 1.0, 2: 0.95, 3: 0.8, 4: 0.4}, 0.6
