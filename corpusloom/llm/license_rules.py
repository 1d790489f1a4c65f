"""The signature rules of the license scan, written by hand.

A line is ``label|keyword|pattern``; its section gives the weight; earlier lines have priority. Texts
are in lower case when they are matched. In patterns a space stands for a gap of one to eight
characters that are neither letters nor digits, `` ?`` for one of up to three, LIC for license or
licence, V for the word version or its short forms between gaps, and E for the end of a version
number. Every text that a rule fits holds each word of its keyword.
"""
from __future__ import annotations

SIGNATURES = r"""
# 1.0 addresses
agpl-3|gnu.org|gnu\.org/licenses/agpl-3(\.0)?
agpl|gnu.org|gnu\.org/licenses/agpl\b
lgpl-2.1|gnu.org|gnu\.org/licenses/(old-licenses/)?lgpl-2\.1
lgpl-3|gnu.org|gnu\.org/licenses/lgpl-3(\.0)?
lgpl|gnu.org|gnu\.org/(licenses|copyleft)/lgpl\b
gpl-2|gnu.org|gnu\.org/licenses/(old-licenses/)?gpl-2(\.0)?
gpl-3|gnu.org|gnu\.org/licenses/gpl-3(\.0)?
gpl|gnu.org|gnu\.org/(licenses|copyleft)/gpl\b
gfdl-1.3|gnu.org|gnu\.org/licenses/fdl-1\.3
gfdl|gnu.org|gnu\.org/(licenses|copyleft)/fdl\b
apache-2.0|apache.org|apache\.org/licenses/license-2\.0
apache|apache.org|apache\.org/licenses/(?!license-2\.0)
mit|opensource.org|opensource\.org/licen[cs]es?/mit\b
bsd-3-clause|opensource.org|opensource\.org/licen[cs]es?/bsd-3-clause
bsd-2-clause|opensource.org|opensource\.org/licen[cs]es?/bsd-2-clause
bsd|opensource.org|opensource\.org/licen[cs]es?/bsd-license
isc|opensource.org|opensource\.org/licen[cs]es?/isc\b
apache-2.0|opensource.org|opensource\.org/licen[cs]es?/apache-2\.0
mpl-2.0|mozilla.org|mozilla\.org/(en-us/)?mpl/2\.0
mpl-1.1|mozilla.org|mozilla\.org/(en-us/)?mpl/(mpl-)?1\.1
mpl|mozilla.org|mozilla\.org/(en-us/)?mpl/?(?![a-z0-9])
epl-2.0|eclipse.org|eclipse\.org/legal/epl-(2\.0|v20)
epl-1.0|eclipse.org|eclipse\.org/legal/epl-v10
boost-1.0|boost.org|boost\.org/license_1_0
unlicense|unlicense.org|unlicense\.org
wtfpl|wtfpl.net|wtfpl\.net
cc0-1.0|creativecommons.org|creativecommons\.org/publicdomain/zero/1\.0
public-domain|creativecommons.org|creativecommons\.org/(publicdomain/mark|licenses/publicdomain)
cc-by-nc-sa-4.0|creativecommons.org|creativecommons\.org/licenses/by-nc-sa/4\.0
cc-by-nc-nd-4.0|creativecommons.org|creativecommons\.org/licenses/by-nc-nd/4\.0
cc-by-nc-4.0|creativecommons.org|creativecommons\.org/licenses/by-nc/4\.0
cc-by-nd-4.0|creativecommons.org|creativecommons\.org/licenses/by-nd/4\.0
cc-by-sa-4.0|creativecommons.org|creativecommons\.org/licenses/by-sa/4\.0
cc-by-sa-3.0|creativecommons.org|creativecommons\.org/licenses/by-sa/3\.0
cc-by-4.0|creativecommons.org|creativecommons\.org/licenses/by/4\.0
cc-by-3.0|creativecommons.org|creativecommons\.org/licenses/by/3\.0
cc-by-2.0|creativecommons.org|creativecommons\.org/licenses/by/2\.0
odbl-1.0|opendatacommons.org|opendatacommons\.org/licenses/odbl
odc-by|opendatacommons.org|opendatacommons\.org/licenses/by\b
pddl|opendatacommons.org|opendatacommons\.org/licenses/pddl
ofl-1.1|scripts.sil.org|scripts\.sil\.org/ofl
# 0.95 names with a version
agpl-1|affero|(gnu )?affero general public LICV1(\.0)?E
agpl-3|affero|(gnu )?affero general public LICV3(\.0)?E
agpl-3|affero|version 3(\.0)? of the gnu affero general public LIC
agpl-3|affero|(gnu )?affero general public LIC as published by the free software foundation either version 3
agpl-3|agpl|\bagpl ?v?3(\.0)?E
lgpl-2|library general public|(gnu )?library general public LICV2(\.0)?E
lgpl-2.1|lesser general public|(gnu )?lesser general public LICV2\.1E
lgpl-3|lesser general public|(gnu )?lesser general public LICV3(\.0)?E
lgpl-2.1|lesser general public|version 2\.1 of the (gnu )?lesser general public LIC
lgpl-3|lesser general public|version 3(\.0)? of the (gnu )?lesser general public LIC
lgpl-2.1|lesser general public|(gnu )?lesser general public LIC as published by the free software foundation either version 2\.1
lgpl-3|lesser general public|(gnu )?lesser general public LIC as published by the free software foundation either version 3
lgpl-2|lgpl|\blgpl ?v?2(\.0)?E
lgpl-2.1|lgpl|\blgpl ?v?2\.1E
lgpl-3|lgpl|\blgpl ?v?3(\.0)?E
gpl-1|general public|(gnu )?general public LICV1(\.0)?E
gpl-2|general public|(gnu )?general public LICV2(\.0)?E
gpl-3|general public|(gnu )?general public LICV3(\.0)?E
gpl-2|general public|version 2(\.0)? of the (gnu )?general public LIC
gpl-3|general public|version 3(\.0)? of the (gnu )?general public LIC
gpl-2|general public|(gnu )?general public LIC as published by the free software foundation either version 2
gpl-3|general public|(gnu )?general public LIC as published by the free software foundation either version 3
gpl-1|gpl|\bgpl ?v?1(\.0)?E
gpl-2|gpl|\bgpl ?v?2(\.0)?E
gpl-3|gpl|\bgpl ?v?3(\.0)?E
gfdl-1.1|free documentation|(gnu )?free documentation LICV1\.1E
gfdl-1.2|free documentation|(gnu )?free documentation LICV1\.2E
gfdl-1.3|free documentation|(gnu )?free documentation LICV1\.3E
apache-1.0|apache|apache (software )?LICV1\.0E
apache-1.1|apache|apache (software )?LICV1\.1E
apache-2.0|apache|apache (software )?LICV2(\.0)?E
apache-2.0|apache|\bapache ?2(\.0)?E
apache-2.0|asl|\basl ?2(\.0)?E
mpl-1.0|mozilla public|mozilla public LICV1\.0E
mpl-1.1|mozilla public|mozilla public LICV1\.1E
mpl-2.0|mozilla public|mozilla public LICV2(\.0)?E
mpl-1.1|mpl|\bmpl ?v?1\.1E
mpl-2.0|mpl|\bmpl ?v?2(\.0)?E
epl-1.0|eclipse public|eclipse public LICV1(\.0)?E
epl-2.0|eclipse public|eclipse public LICV2(\.0)?E
edl-1.0|eclipse distribution|eclipse distribution LICV1(\.0)?E
cddl-1.0|development and distribution|common development and distribution LICV1(\.0)?E
cddl-1.1|development and distribution|common development and distribution LICV1\.1E
cddl-1.0|cddl|\bcddl ?v?1(\.0)?E
cpl-1.0|common public|common public LICV1(\.0)?E
eupl-1.1|european union public|european union public LICV1\.1E
eupl-1.2|european union public|european union public LICV1\.2E
eupl-1.2|eupl|\beupl ?v?1\.2E
osl-3.0|open software|open software LICV3(\.0)?E
afl-3.0|academic free|academic free LICV3(\.0)?E
afl-2.1|academic free|academic free LICV2\.1E
artistic-1.0|artistic|artistic LICV1(\.0)?E
artistic-2.0|artistic|artistic LICV2(\.0)?E
cecill-2.1|cecill|\bcecill( free software)?( LIC)?( agreement)?V2\.1E
ofl-1.0|open font|(sil )?open font LICV1\.0E
ofl-1.1|open font|(sil )?open font LICV1\.1E
odbl-1.0|open database|(open data commons )?open database LICV1(\.0)?E
boost-1.0|boost software|boost software LICV1(\.0)?E
zpl-2.1|zope public|zope public LICV2\.1E
lppl-1.3|latex project public|latex project public LICV1\.3
psf-2|python software foundation|python software foundation LICV2E
php-3.01|php|\bphp LICV3\.01E
php-3.0|php|\bphp LICV3(\.0)?E
ecl-2.0|educational community|educational community LICV2(\.0)?E
apsl-2.0|apple public source|apple public source LICV2(\.0)?E
qpl-1.0|q public|\bq public LICV1(\.0)?E
upl-1.0|universal permissive|universal permissive LICV1(\.0)?E
mulan-1|mulan|mulan (permissive software|psl) ?(LIC)?V1E
mulan-2|mulan|mulan (permissive software|psl) ?(LIC)?V2E
bsl-1.1|business source|business source LICV1\.1E
sspl-1|server side public|server side public LICV1E
elastic-2.0|elastic|elastic LICV2(\.0)?E
cc0-1.0|cc0|\bcc0 ?1\.0E
cc0-1.0|creative commons zero|creative commons zero( universal)?V1\.0E
cc-by-nc-sa-4.0|creative commons attribution|creative commons attribution non ?commercial share ?alikeI4\.0E
cc-by-nc-sa-3.0|creative commons attribution|creative commons attribution non ?commercial share ?alikeI3\.0E
cc-by-nc-nd-4.0|creative commons attribution|creative commons attribution non ?commercial no ?deriv(ative)?sI4\.0E
cc-by-nc-nd-3.0|creative commons attribution|creative commons attribution non ?commercial no ?deriv(ative)?sI3\.0E
cc-by-nc-4.0|creative commons attribution|creative commons attribution non ?commercialI4\.0E
cc-by-nc-3.0|creative commons attribution|creative commons attribution non ?commercialI3\.0E
cc-by-nd-4.0|creative commons attribution|creative commons attribution no ?deriv(ative)?sI4\.0E
cc-by-sa-4.0|creative commons attribution|creative commons attribution share ?alikeI4\.0E
cc-by-sa-3.0|creative commons attribution|creative commons attribution share ?alikeI3\.0E
cc-by-sa-2.5|creative commons attribution|creative commons attribution share ?alikeI2\.5E
cc-by-4.0|creative commons attribution|creative commons attributionI4\.0E
cc-by-3.0|creative commons attribution|creative commons attributionI3\.0E
cc-by-2.5|creative commons attribution|creative commons attributionI2\.5E
cc-by-2.0|creative commons attribution|creative commons attributionI2\.0E
cc-by-nc-sa-4.0|cc|\bcc by nc sa ?4\.0E
cc-by-nc-nd-4.0|cc|\bcc by nc nd ?4\.0E
cc-by-nc-4.0|cc|\bcc by nc ?4\.0E
cc-by-nd-4.0|cc|\bcc by nd ?4\.0E
cc-by-sa-4.0|cc|\bcc by sa ?4\.0E
cc-by-sa-3.0|cc|\bcc by sa ?3\.0E
cc-by-4.0|cc|\bcc by ?4\.0E
cc-by-3.0|cc|\bcc by ?3\.0E
# 0.9 passages of license texts
mit|permission is hereby granted|permission is hereby granted free of charge to any person obtaining a copy
mit|above copyright notice|the above copyright notice and this permission notice shall be included in all copies or substantial portions
isc|permission to use|permission to use copy modify and or distribute this software for any purpose
bsd|redistribution and use|redistribution and use in source and binary forms with or without modification
bsd|redistribution and use|redistribution and use in source and binary forms(?! with or without)
bsd|redistributions of source|redistributions of source code must retain the above copyright notice
bsd-3-clause|endorse or promote|may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause|advertising materials|all advertising materials mentioning features or use of this software must display
apache|may not use this file|you may not use this file except in compliance with the LIC
apache|unless required by applicable|unless required by applicable law or agreed to in writing
gpl|free software|this program is free software you can redistribute it and or modify
gpl|redistribute it|redistribute it and or modify it under the terms of the gnu general public LIC
lgpl|this library is free software|this library is free software you can redistribute it and or modify
mpl|source code form|this source code form is subject to the terms of the mozilla public LIC
zlib|origin of this software|the origin of this software must not be misrepresented
zlib|altered source versions|altered source versions must be plainly marked as such
boost|machine executable object|solely in the form of machine executable object code
unlicense|unencumbered|this is free and unencumbered software released into the public domain
wtfpl|what the|do what the f\S{1,8} you want to public LIC
gfdl|invariant sections|with no invariant sections no front cover texts and no back cover texts
ofl|reserved font name|with reserved font name
cc0|waived all copyright|has waived all copyright and related or neighboring rights
artistic|reasonable copying fee|reasonable copying fee
no-warranty|warranty|provided as is without (express or implied )?warranty
no-warranty|warranty|is provided as is without warranty of any kind
no-warranty|warranty|without any warranty without even the implied warranty
no-warranty|merchantability|warranties of merchantability fitness for a particular purpose
no-liability|be liable|in no event shall the (authors?|copyright holders?|regents)( or copyright holders)?( or contributors)? be liable
beerware|buy me a beer|you can buy me a beer in return
public-domain|public domain|(released|placed|dedicated|is|are) (in|into|to) the public domain
proprietary|proprietary|(proprietary and confidential|confidential and proprietary)
proprietary|unauthorized copying|unauthorized copying of this (file|document|material)
proprietary|trade secret|contains (confidential information and )?trade secrets?
proprietary|written permission|may not be (copied|reproduced|distributed) without( the)?( prior| express)* written permission
proprietary|licensed not sold|licensed not sold
reserved|vorbehalten|alle rechte vorbehalten
reserved|droits|tous droits réservés
reserved|derechos|(todos los derechos reservados|reservados todos los derechos)
reserved|diritti|tutti i diritti riservati
copyright|copyright|copyright( c| ©)? (19|20)[0-9]{2}
# 0.8 names
agpl|affero|(gnu )?affero general public LIC
agpl|agpl|\bagpl\b(?! ?v?3)
lgpl|lesser general public|(gnu )?lesser general public LIC
lgpl|library general public|(gnu )?library general public LIC
lgpl|lgpl|\blgpl\b(?! ?v?[23])
gpl|general public|(gnu )?general public LIC
gpl|gnu gpl|gnu gpl(?! ?v?[123])
gfdl|free documentation|(gnu )?free documentation LIC
classpath-exception|classpath|classpath( linking)? exception
apache|apache|apache (software )?LIC
mpl|mozilla public|mozilla public LIC
epl|eclipse public|eclipse public LIC
cddl|development and distribution|common development and distribution LIC
cpl|common public|common public LIC
eupl|european union public|european union public LIC
osl|open software|open software LIC
afl|academic free|academic free LIC
artistic|artistic|artistic LIC
cecill|cecill|\bcecill
ofl|open font|(sil )?open font LIC
odbl|database|open (data commons |data commons open )?database LIC
odc-by|open data commons|open data commons attribution LIC
boost|boost software|boost software LIC
zpl|zope public|zope public LIC
lppl|latex project public|latex project public LIC
ms-pl|microsoft public|microsoft public LIC
ms-rl|microsoft reciprocal|microsoft reciprocal LIC
psf|python software foundation|python software foundation LIC
php|php|\bphp LIC
ecl|educational community|educational community LIC
rpl|reciprocal public|reciprocal public LIC
spl|sun public|sun public LIC
ibm-pl|ibm public|ibm public LIC
apsl|apple public source|apple public source LIC
qpl|q public|\bq public LIC
upl|universal permissive|universal permissive LIC
mulan|mulan|mulan permissive software LIC
bsl|business source|business source LIC
sspl|server side public|server side public LIC
elastic|elastic|elastic LIC
cc0|cc0|\bcc0\b(?! ?1\.0)
cc0|creative commons zero|creative commons zero
cc-by-nc-sa|creative commons attribution|creative commons attribution non ?commercial share ?alike
cc-by-nc-nd|creative commons attribution|creative commons attribution non ?commercial no ?deriv(ative)?s
cc-by-nc|creative commons attribution|creative commons attribution non ?commercial
cc-by-nd|creative commons attribution|creative commons attribution no ?deriv(ative)?s
cc-by-sa|creative commons attribution|creative commons attribution share ?alike
cc-by|creative commons attribution|creative commons attribution
cc-by-nc-sa|cc|\bcc by nc sa
cc-by-nc-nd|cc|\bcc by nc nd
cc-by-nc|cc|\bcc by nc
cc-by-nd|cc|\bcc by nd
cc-by-sa|cc|\bcc by sa
mit|mit|\b(the )?mit LIC
mit|expat|\b(the )?expat LIC
mit-0|mit no attribution|\bmit no attribution
bsd-4-clause|bsd|\b((bsd )?(4|four) clause bsd|bsd (4|four) clause|original bsd)( LIC)?
bsd-3-clause|bsd|\b((3|three) clause bsd|bsd (3|three) clause|(new|modified|revised) bsd)( LIC)?
bsd-2-clause|bsd|\b((2|two) clause bsd|bsd (2|two) clause|(simplified|free) bsd)( LIC)?
0bsd|bsd|\b(0bsd|zero clause bsd|bsd zero clause)( LIC)?
bsd|bsd|\bbsd( style)? LIC
isc|isc|\bisc LIC
zlib|zlib|\bzlib( libpng)? LIC
ncsa|ncsa|\bncsa (open source )?LIC
x11|x11|\bx11 LIC
postgresql|postgresql|\bpostgresql LIC
openssl|openssl|\bopenssl LIC
ruby|ruby|\bruby LIC
vim|vim|\bvim LIC
w3c|w3c|\bw3c software( notice and)? LIC
curl|curl|\bcurl LIC
json|json|\bjson LIC
hpnd|historical permission|historical permission notice and disclaimer
unicode|unicode|\bunicode (LIC agreement|terms of use)
unlicense|unlicense|\b(the )?unlicense\b(?!\.org)
wtfpl|wtfpl|\bwtfpl\b(?!\.net)
beerware|beer|\b(the )?beer ?ware LIC
openrail|rail|\b(bigscience |creativeml )?open ?rail ?m?\b
llama|llama|\bllama [0-9.]{1,3} community LIC
"""

#: SPDX license identifiers in lower case, as far as this scan names them.
SPDX_IDS = (r"0bsd|afl-(?:1\.[12]|2\.[01]|3\.0)|agpl-[13](?:\.0)?|apache-(?:1\.[01]|2\.0)|apsl-2\.0|artistic-[12]\.0|beerware|blueoak-1\.0\.0"
            r"|bsd-[1234]-clause(?:-clear|-patent)?|bsl-1\.0|busl-1\.1|cc0-1\.0|cc-by(?:-nc)?(?:-sa|-nd)?-(?:1\.0|2\.[05]|3\.0|4\.0)|cddl-1\.[01]|cecill-(?:1\.[01]|2\.[01]|b|c)|cpl-1\.0"
            r"|curl|ecl-[12]\.0|elastic-2\.0|epl-[12]\.0|eupl-1\.[012]|gfdl-1\.[123]|gpl-[123](?:\.0)?|hpnd|isc|json|lgpl-(?:2\.[01]|[23](?:\.0)?)|lppl-1\.[0123]c?"
            r"|mit(?:-0)?|mpl-(?:1\.[01]|2\.0)|ms-pl|ms-rl|mulanpsl-[12]\.0|ncsa|odbl-1\.0|odc-by-1\.0|ofl-1\.[01]|openssl|osl-(?:1\.0|2\.[01]|3\.0)|pddl-1\.0"
            r"|php-3\.01?|postgresql|psf-2\.0|python-2\.0|qpl-1\.0|rpl-1\.[15]|ruby|sspl-1\.0|unicode-dfs-2016|unlicense|upl-1\.0|vim|w3c|wtfpl|x11|zlib|zpl-(?:1\.1|2\.[01])")


def rules() -> list[tuple[str, str, str, float]]:
    """(keyword, regex, label, weight) in the order of priority."""
    # A gap is any run of other characters. No two gaps stand side by side, so that a long run is not
    # tried in every split.
    gap = "[^a-z0-9]+"
    out, weight = [], 0.0
    for line in SIGNATURES.strip().splitlines():
        if line.startswith("# "):
            weight = float(line.split()[1])
            continue
        label, keyword, p = line.split("|", 2)
        p = p.replace("LIC", "licen[cs]e").replace(" ?", "[^a-z0-9]*").replace(" ", gap)
        p = p.replace("V", "(?:[^a-z0-9]*(?:version|ver|v))?[^a-z0-9]*").replace("I", "[^a-z0-9]+(?:international[^a-z0-9]+)?(?:(?:version|v)[^a-z0-9]*)?").replace("E", "(?![0-9.]*[0-9])")
        out.append((keyword, p if p.startswith(r"\b") else rf"\b(?:{p})", label, weight))
    return out
