"""The license signatures: hand-written expressions over lower-case words with one space between them.

Fixed values: names, identifiers and phrases of public licenses; every line of NAMED and PHRASES is one rule written by hand, and a
name counts in three forms. Each line of NAMED is `label | keyword | name`, where name
is an expression for how texts write the license; FORMS says in which phrases a name counts and at what priority. PHRASES
are whole expressions of their own: `label | priority | keyword | expression`. Each of them holds a word of TRIGGERS.
"""

from __future__ import annotations

NAMED = """
0bsd | 0bsd | 0bsd
0bsd | bsd | (?:zero clause bsd|bsd zero clause)
afl-3 | academic | academic free license(?: v| version)? ?3(?: 0)?
agpl-3 | affero | (?:gnu )?affero (?:general public license|gpl)(?: v| version)? ?3(?: 0)?
agpl-3 | agpl | (?:gnu )?agpl ?(?:v|version )?3(?: 0)?
agpl | affero | (?:gnu )?affero general public license
apache-1.1 | apache | apache (?:software )?license(?: v| version)? ?1 1
apache-2 | apache | apache (?:software )?license(?: v| version)? ?2(?: 0)?
apache-2 | apache | apache ?(?:v ?)?2(?: 0)?
apache | apache | apache (?:software )?license
apsl-2 | apple | apple public source license(?: version)? 2(?: 0)?
artistic-1 | artistic | artistic license(?: version)? 1(?: 0)?
artistic-2 | artistic | artistic license(?: version)? 2(?: 0)?
artistic | artistic | artistic license
beerware | beer | beer ?ware license
blueoak-1 | oak | blue oak model license(?: version)? 1(?: 0 0)?
bsd-2 | bsd | (?:2 clause|two clause|simplified|freebsd) bsd
bsd-2 | bsd | bsd (?:2|two) clause
bsd-3 | bsd | (?:3 clause|three clause|new|modified|revised) bsd
bsd-3 | bsd | bsd (?:3|three) clause
bsd-4 | bsd | (?:4 clause|four clause|original) bsd
bsd-4 | bsd | bsd (?:4|four) clause
bsd | bsd | bsd(?: style)?
bsl-1 | boost software license | boost software license(?: version)? ?1(?: 0)?
boost | boost software license | boost software license
busl-1.1 | business | business source license(?: version)? ?1 1
cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
cc-by | creative | creative commons attribution(?: [1-4] [05])?(?: international| unported| generic)?
cc-by | by | cc by(?: [1-4] [05])?
cc-by-nc | creative | creative commons attribution non ?commercial(?: [1-4] [05])?(?: international| unported| generic)?
cc-by-nc | by | cc by nc(?: [1-4] [05])?
cc-by-nc-nd | creative | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nc-nd | by | cc by nc nd(?: [1-4] [05])?
cc-by-nc-sa | creative | creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?
cc-by-nc-sa | by | cc by nc sa(?: [1-4] [05])?
cc-by-nd | creative | creative commons attribution no ?deriv(?:ative)?s?(?: works)?(?: [1-4] [05])?
cc-by-nd | by | cc by nd(?: [1-4] [05])?
cc-by-sa | creative | creative commons attribution share ?alike(?: [1-4] [05])?
cc-by-sa | by | cc by sa(?: [1-4] [05])?
cddl-1 | cddl | cddl(?: 1 [01])?
cddl-1 | distribution | common development and distribution license(?: version)?(?: 1 [01])?
cecill-2.1 | cecill | cecill(?: 2 1)?
cpl-1 | common | common public license(?: version)?(?: 1 0)?
ecl-2 | educational | educational community license(?: version)?(?: 2 0)?
epl-1 | eclipse | eclipse public license(?: v| version)? ?1(?: 0)?
epl-2 | eclipse | eclipse public license(?: v| version)? ?2(?: 0)?
epl | eclipse | eclipse public license
eupl-1.2 | european | european union public licen[cs]e(?: version)?(?: 1 2)?
eupl-1.2 | eupl | eupl(?: 1 2)?
gfdl-1.3 | documentation | (?:gnu )?free documentation license(?: version)?(?: 1 [123])?
gpl-1 | gpl | (?:gnu )?gpl ?(?:v|version )?1(?: 0)?
gpl-2 | general | (?:gnu )?general public license(?: v| version)? ?2(?: 0)?
gpl-2 | gpl | (?:gnu )?gpl ?(?:v|version )?2(?: 0)?
gpl-3 | general | (?:gnu )?general public license(?: v| version)? ?3(?: 0)?
gpl-3 | gpl | (?:gnu )?gpl ?(?:v|version )?3(?: 0)?
gpl | general | gnu general public license
gpl | gpl | (?:gnu )?gpl
isc | isc | isc
lgpl-2 | library | (?:gnu )?library general public license(?: v| version)? ?2(?: 0)?
lgpl-2.1 | lesser | (?:gnu )?lesser general public license(?: v| version)? ?2 1
lgpl-2.1 | lgpl | (?:gnu )?lgpl ?(?:v|version )?2 1
lgpl-3 | lesser | (?:gnu )?lesser general public license(?: v| version)? ?3(?: 0)?
lgpl-3 | lgpl | (?:gnu )?lgpl ?(?:v|version )?3(?: 0)?
lgpl | lesser | (?:gnu )?lesser general public license
lppl-1.3 | latex | latex project public license(?: version)?(?: 1 3[ac]?)?
mit | mit | (?:mit|mit x11|x11 mit)
mit | expat | expat
mit-0 | mit | mit (?:0|no attribution)
mpl-1.1 | mozilla | mozilla public license(?: v| version)? ?1 1
mpl-2 | mozilla | mozilla public license(?: v| version)? ?2(?: 0)?
mpl-2 | mpl | mpl ?(?:v|version )?2(?: 0)?
mpl | mozilla | mozilla public license
ms-pl | microsoft | microsoft public license
ms-rl | microsoft | microsoft reciprocal license
mulan-2 | mulan | mulan p(?:ermissive )?s(?:oftware )?l(?:icense)?(?: v| version)? ?2
ncsa | illinois | university of illinois ncsa(?: open source)?
odbl-1 | database | open database license(?: v| version)?(?: 1 0)?
odc-by-1 | commons | open data commons attribution license(?: v| version)?(?: 1 0)?
ofl-1.1 | sil | sil open font license(?: v| version)?(?: 1 1)?
osl-3 | open | open software license(?: v| version)? ?3(?: 0)?
pddl-1 | dedication | (?:open data commons )?public domain dedication and license(?: 1 0)?
php-3 | php | php license(?: v| version)? ?3(?: 01?)?
postgresql | postgresql | postgresql
psf-2 | python | python(?: software foundation)? license(?: v| version)?(?: 2)?
ruby | ruby | ruby
sspl-1 | server | server side public license(?: v| version)?(?: 1)?
unlicense | unlicense | unlicense
upl-1 | universal | universal permissive license(?: v| version)?(?: 1 0)?
vim | vim | vim
w3c | w3c | w3c software(?: notice and)?
wtfpl | wtfpl | wtfpl
zlib | zlib | zlib(?: libpng)?
zpl-2.1 | zope | zope public license(?: v| version)?(?: 2 1)?
"""

#: form, priority, confidence in hundredths, what a text must hold, expression around a name. A longer name beats a shorter one of its priority by containment.
GRANT = r"(?:licen[cs]ed|released|distributed|published|provided|available|covered) under"
FORMS = [
    ("grant", 3, 95, " under ", GRANT + r" (?:the )?(?:terms (?:and conditions )?of )?(?:the )?{name}(?: licen[cs]e)?"),
    ("spdx", 4, 99, " spdx ", r"spdx licen[cs]e identifier {name}"),
    ("title", 2, 80, " licen", r"(?:the )?{name} licen[cs]e"),
]

PHRASES = """
gpl | 3 | general public license | under the terms of the gnu general public license as published by the free software foundation
gpl-2-or-later | 4 | any later version | either version 2 of the license or at your option any later version
gpl-3-or-later | 4 | any later version | either version 3 of the license or at your option any later version
gpl-3 | 4 | license version | gnu general public license version 3
gpl-2 | 4 | license version | gnu general public license version 2
lgpl | 3 | lesser general public license | under the terms of the gnu lesser general public license
agpl | 3 | affero general public license | under the terms of the gnu affero general public license
apache-2 | 4 | apache | apache org licenses license 2 0
apache-2 | 3 | in compliance with the license | you may not use this file except in compliance with the license
mit | 3 | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy
mit | 4 | opensource org licenses | opensource org licenses mit(?: license)?
bsd | 3 | source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
bsd-3 | 4 | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | 4 | all advertising materials | all advertising materials mentioning features or use of this software
bsd-2 | 4 | opensource org licenses | opensource org licenses bsd 2 clause
bsd-3 | 4 | opensource org licenses | opensource org licenses bsd 3 clause
isc | 3 | permission to use copy | permission to use copy modify and or distribute this software for any purpose
zlib | 3 | altered source versions | altered source versions must be plainly marked as such
unlicense | 3 | free and unencumbered software | this is free and unencumbered software released into the public domain
cc0-1 | 4 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by | 4 | creativecommons | creativecommons org licenses by [1-4] [05]
cc-by-sa | 4 | creativecommons | creativecommons org licenses by sa [1-4] [05]
cc-by-nd | 4 | creativecommons | creativecommons org licenses by nd [1-4] [05]
cc-by-nc | 4 | creativecommons | creativecommons org licenses by nc [1-4] [05]
cc-by-nc-sa | 4 | creativecommons | creativecommons org licenses by nc sa [1-4] [05]
cc-by-nc-nd | 4 | creativecommons | creativecommons org licenses by nc nd [1-4] [05]
mpl-2 | 3 | mozilla public license | subject to the terms of the mozilla public license v 2 0
mpl-2 | 4 | mozilla org mpl | mozilla org mpl 2 0
epl-2 | 4 | legal epl | eclipse org legal epl 2 0
bsl-1 | 3 | boost software license | boost software license version 1 0
ofl-1.1 | 4 | sil org ofl | scripts sil org ofl
wtfpl | 3 | public license | do what the fuck you want to public license
public-domain | 2 | public domain | (?:released|placed|dedicated|is|are) (?:in|into|to) the public domain
public-domain | 2 | public domain | public domain dedication
proprietary | 2 | rights reserved | all rights reserved
proprietary | 2 | may be reproduced | no part of this (?:work|publication|book|document) may be reproduced
proprietary | 2 | proprietary and confidential | proprietary and confidential
proprietary | 2 | unauthorized | unauthorized (?:copying|use|reproduction|distribution)(?: of this (?:file|software))?
copyright | 1 | copyright | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
non-commercial | 2 | commercial use only | for non commercial use only
non-commercial | 2 | noncommercial use only | for noncommercial use only
no-derivatives | 2 | no derivative works | no derivative works
mit | 3 | without restriction | to deal in the software without restriction including without limitation the rights to use
mit | 3 | copies or substantial portions | shall be included in all copies or substantial portions of the software
mit | 2 | software is provided | the software is provided as is without warranty of any kind express or implied
mit | 3 | other dealings | other dealings in the software
mit-0 | 4 | without attribution | permission is hereby granted (?:free of charge )?to use this software without attribution
bsd | 3 | redistributions of source code | redistributions of source code must retain the (?:above )?copyright notice
bsd | 3 | redistributions in binary form | redistributions in binary form must reproduce the (?:above )?copyright notice
bsd | 2 | copyright holders and contributors | this software is provided by the copyright holders and contributors as is
bsd | 2 | regents | this software is provided by the regents and contributors as is
bsd-3 | 4 | nor the names of its contributors | nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4 | 4 | includes software developed | this product includes software developed by
0bsd | 4 | with or without fee is hereby granted | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software
isc | 3 | software is provided | the software is provided as is and the author disclaims all warranties
isc | 3 | internet systems consortium | copyright(?: c)? (?:[0-9]{4} )?(?:by )?internet systems consortium
hpnd | 3 | documentation for any purpose | permission to use copy modify (?:and )?distribute (?:and sell )?this software and its documentation for any purpose
apache-2 | 3 | see the license | see the license for the specific language governing permissions and limitations under the license
apache-2 | 3 | warranties or conditions | on an as is basis without warranties or conditions of any kind either express or implied
apache-2 | 3 | contributor license agreements | licensed to the apache software foundation asf under one or more contributor license agreements
apache-2 | 4 | asf licenses this file | the asf licenses this file to you under the apache license
apache-2 | 4 | opensource org licenses | opensource org licenses apache 2 0
apache-2 | 3 | grant of patent license | grant of patent license subject to the terms and conditions of this license
apache-1.1 | 4 | software developed by the apache | this product includes software developed by the apache software foundation
gpl | 3 | free software you can redistribute | this program is free software you can redistribute it and or modify
gpl | 3 | free software you can redistribute | this (?:library|file|package|work) is free software you can redistribute it and or modify
gpl | 3 | hope that it will be useful | distributed in the hope that it will be useful but without any warranty
gpl | 2 | fitness for a particular purpose | without even the implied warranty of merchantability or fitness for a particular purpose
gpl | 3 | received a copy of the gnu | you should have received a copy of the gnu general public license
gpl | 4 | gnu org licenses | gnu org licenses gpl(?: html| txt)?
gpl-2 | 4 | gnu org licenses | gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?
gpl-3 | 4 | gnu org licenses | gnu org licenses gpl 3 0(?: html| txt)?
gpl-2 | 4 | opensource org licenses | opensource org licenses gpl 2 0
gpl-3 | 4 | opensource org licenses | opensource org licenses gpl 3 0
gpl-2 | 4 | as published by the free | license version 2 as published by the free software foundation
gpl-3 | 4 | as published by the free | license version 3 as published by the free software foundation
gpl | 2 | free software foundation | free software foundation inc (?:59 temple place|51 franklin street)
gpl-3 | 3 | everyone is permitted | everyone is permitted to copy and distribute verbatim copies of this license document
gpl-linking-exception | 4 | special exception | as a special exception the copyright holders of this (?:library|program) give you permission to link
classpath-exception | 4 | linking this library | linking this library statically or dynamically with other modules is making a combined work
gcc-exception | 4 | runtime library exception | gcc runtime library exception
font-exception | 4 | embed this font | as a special exception if you create a document which uses this font and embed this font
lgpl | 3 | received a copy of the gnu lesser | you should have received a copy of the gnu lesser general public license
lgpl | 3 | received a copy of the gnu library | you should have received a copy of the gnu library general public license
lgpl-2.1 | 4 | gnu org licenses | gnu org licenses (?:old licenses )?lgpl 2 1(?: html| txt)?
lgpl-3 | 4 | gnu org licenses | gnu org licenses lgpl(?: 3 0)?(?: html| txt)?
agpl-3 | 4 | gnu org licenses | gnu org licenses agpl(?: 3 0)?(?: html| txt)?
agpl | 3 | received a copy of the gnu affero | you should have received a copy of the gnu affero general public license
agpl-3 | 3 | remote network interaction | remote network interaction use with the gnu general public license
gfdl-1.3 | 3 | copy distribute and or modify this document | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl-1.3 | 4 | invariant sections | with no invariant sections no front cover texts and no back cover texts
mpl-2 | 3 | source code form is subject | this source code form is subject to the terms of the mozilla public license
mpl-2 | 4 | incompatible with secondary licenses | this source code form is incompatible with secondary licenses
mpl-1.1 | 4 | mozilla org mpl | mozilla org mpl mpl 1 1(?: html| txt)?
mpl-1.1 | 3 | contents of this file are subject | the contents of this file are subject to the mozilla public license version 1 1
mpl | 2 | contents of this file are subject | the contents of this file are subject to the (?:netscape|mozilla) public license
cddl-1 | 3 | contents of this file are subject | the contents of this file are subject to the terms of the common development and distribution license
cddl-1 | 4 | opensource org licenses | opensource org licenses cddl1(?: txt| php)?
epl-1 | 4 | legal epl | eclipse org legal epl v10(?: html)?
epl-2 | 4 | legal epl | eclipse org legal epl v20(?: html)?
epl | 3 | accompanying materials | this program and the accompanying materials are made available under the terms of the eclipse public license
edl-1 | 4 | distribution license | eclipse distribution license(?: v| version)? 1 0
cpl-1 | 4 | opensource org licenses | opensource org licenses cpl1 0(?: txt| php)?
ipl-1 | 4 | ibm public license | ibm public license(?: v| version)?(?: 1 0)?
artistic-1 | 3 | conditions under which a package may be copied | the intent of this document is to state the conditions under which a package may be copied
artistic-2 | 4 | opensource org licenses | opensource org licenses artistic license 2 0
perl | 3 | same terms as perl | (?:redistribute|redistributed) it and or modify it under the same terms as perl(?: itself)?
psf-2 | 3 | python software foundation | copyright(?: c)? (?:[0-9]{4} )?(?:[0-9]{4} )?python software foundation
psf-2 | 4 | agreement for python | psf license agreement for python
zlib | 3 | origin of this software | the origin of this software must not be misrepresented
zlib | 3 | arising from the use of this software | in no event will the authors be held liable for any damages arising from the use of this software
zlib | 3 | permission is granted to anyone | permission is granted to anyone to use this software for any purpose including commercial applications
bsl-1 | 4 | boost org license | boost org license 1 0(?: txt)?
bsl-1 | 3 | person or organization obtaining a copy | permission is hereby granted free of charge to any person or organization obtaining a copy
unlicense | 4 | unlicense org | unlicense org
unlicense | 3 | anyone is free to copy | anyone is free to copy modify publish use compile sell or distribute this software
cc0-1 | 3 | waived all copyright | (?:has|have) waived all copyright and related or neighboring rights
cc0-1 | 3 | cc0 | dedicated to the public domain under cc0
cc-by | 2 | reproduction in any medium | permits unrestricted use distribution and reproduction in any medium provided the original (?:work|author and source)(?: are| is)? properly
cc-by | 3 | open access article | this is an open access article distributed under the terms of the creative commons attribution license
cc-by | 3 | redistribute the material | you are free to share copy and redistribute the material in any medium or format
cc-by-sa | 3 | distribute your contributions | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | 3 | commercial purposes | you may not use the material for commercial purposes
cc-by-nd | 3 | modified material | if you remix transform or build upon the material you may not distribute the modified material
cc-by | 3 | appropriate credit | you must give appropriate credit provide a link to the license and indicate if changes were made
cc | 2 | some rights reserved | some rights reserved
cc | 2 | creative commons license | (?:under|with) a creative commons license
odbl-1 | 4 | opendatacommons | opendatacommons org licenses odbl(?: 1 0)?
odc-by-1 | 4 | opendatacommons | opendatacommons org licenses by(?: 1 0)?
pddl-1 | 4 | opendatacommons | opendatacommons org licenses pddl(?: 1 0)?
ofl-1.1 | 3 | font software | this font software is licensed under the sil open font license
ofl-1.1 | 3 | reserved font name | with reserved font name
ofl-1.1 | 4 | openfontlicense | openfontlicense org
ogl-uk-3 | 4 | open government | open government licen[cs]e(?: v| version)? 3(?: 0)?
ogl-uk | 3 | open government | contains public sector information licensed under the open government licen[cs]e
crown-copyright | 2 | crown copyright | crown copyright
us-government-work | 3 | work of the united states government | (?:is|as) a work of the united states government
us-government-work | 3 | copyright protection | not subject to copyright protection in the united states
eupl-1.2 | 4 | eupl | licensed under the eupl
ecl-2 | 4 | opensource org licenses | opensource org licenses ecl 2 0
upl-1 | 4 | opensource org licenses | opensource org licenses upl
ncsa | 4 | opensource org licenses | opensource org licenses ncsa
isc | 4 | opensource org licenses | opensource org licenses isc
afl-3 | 4 | opensource org licenses | opensource org licenses afl 3 0
osl-3 | 4 | opensource org licenses | opensource org licenses osl 3 0
w3c | 3 | w3c | w3c software notice and license
w3c | 3 | w3c document | w3c document (?:notice and )?license
json | 4 | good not evil | the software shall be used for good not evil
wtfpl | 4 | what the fuck you want to | you just do what the fuck you want to
beerware | 4 | buy me a beer | if we meet some day and you think this stuff is worth it you can buy me a beer
vim | 3 | vim license | distributed under the terms of the vim license
curl | 4 | curl | curl license
openssl | 3 | openssl | this product includes software developed by the openssl project
openssl | 4 | openssl license | openssl license
ssleay | 4 | eric young | this product includes cryptographic software written by eric young
ijg | 4 | independent jpeg group | this software is based in part on the work of the independent jpeg group
libpng | 4 | libpng | libpng license
freetype | 4 | freetype | portions of this software are copyright (?:c )?(?:[0-9]{4} )?the freetype project
x11 | 3 | x consortium | the name of the x consortium shall not be used in advertising
icu | 4 | international business machines | copyright(?: c)? (?:[0-9]{4} )?(?:[0-9]{4} )?international business machines corporation and others
unicode | 4 | unicode | unicode (?:inc )?license agreement data files and software
elastic-2 | 4 | elastic license | elastic license(?: v| version)? 2(?: 0)?
busl-1.1 | 3 | change license | the change license
commons-clause | 4 | commons clause | commons clause license condition(?: v| version)?(?: 1 0)?
polyform-nc | 4 | polyform | polyform noncommercial license(?: 1 0 0)?
ms-lpl | 4 | limited public license | microsoft limited public license
ms-eula | 2 | license terms | microsoft software license terms
oracle-bcl | 4 | binary code license | oracle binary code license agreement
proprietary | 2 | confidential and proprietary | confidential and proprietary information
proprietary | 2 | written permission | (?:without|except with)(?: the)?(?: express)?(?: prior)? written permission of the (?:publisher|author|copyright (?:holder|owner))
proprietary | 2 | end user license agreement | end user license agreement
proprietary | 2 | reverse engineer | not reverse engineer(?: decompile)?(?: or)?(?: disassemble)? the software
proprietary | 2 | personal use only | licensed for personal use only
proprietary | 2 | evaluation | license is granted for evaluation purposes only
copyright | 1 | copyright | copyright(?: c)? by
copyright | 1 | copyright holder | the copyright holder
"""
#: What begins every hit of some rule somewhere in a text: the words that a text is scanned for at all.
TRIGGERS = [
    "licen[cs](?:es?|ed)", "spdx", "copyright", "permission", "permitted", "redistributions?", "software", "warrant(?:y|ies)", "rights", "reserved", "reproduced", "proprietary", "unauthorized", "commercial", "noncommercial",
    "derivative", "domain", "altered", "creativecommons", "opendatacommons", "openfontlicense", "unlicense", "epl", "mpl", "ofl", "invariant", "interaction", "redistributed?", "material", "publisher", "exception", "linking", "reproduction", "anyone", "unicode", "document", "government", "beer", "fuck", "portions", "consortium",
]


def rules() -> list[tuple[int, str, int, int, str, str, str]]:
    """(order, label, priority, confidence in hundredths, two keywords, expression) of every signature, in order."""
    out = []
    for line in filter(None, NAMED.split("\n")):
        label, keyword, name = line.split(" | ")
        for _, priority, sure, needed, form in FORMS:
            out.append((label, priority, sure, " " + keyword, needed, form.replace("{name}", name)))
    for line in filter(None, PHRASES.split("\n")):
        label, priority, keyword, expression = line.split(" | ")
        out.append((label, int(priority), {4: 99, 3: 95, 2: 80, 1: 50}[int(priority)], " " + keyword, " ", expression))
    return [(i, *rule[:-1], f"(?<= )(?:{rule[-1]})(?= )") for i, rule in enumerate(out)]


def gate() -> str:
    """An expression that every text with a hit of some rule matches: a grant, or one of the words that others hold."""
    return f"(?<= )(?:{GRANT}|{'|'.join(TRIGGERS)})(?= )"


#: (label, phrase) whose places are counted word for word.
PLAIN = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
