"""Signature rules of licences and rights notices: label, priority, keyword, pattern.

A pattern is a sequence of word patterns: ``~w`` is optional, ``..n`` stands for up to n words,
``x ?y`` is x and y as one word or two, anything else is a regular expression for one whole word.
The keyword begins a word of every match; a rule is tried only where its keyword occurs.  Priorities: 4 a notice or a
machine-readable tag, 3 a name with a version or an address, 2 a name, 1 a hint.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    regex: str
    base: bool = False


def compiled(pattern: str) -> str:
    """The regular expression over words that each stand between two spaces of their own."""
    parts = []
    for item in pattern.split():
        if item.startswith(".."):
            parts.append(rf"(?: [^ ]+ ){{0,{int(item[2:])}}}?")
        elif item.startswith("~"):
            parts.append(f"(?: (?:{item[1:]}) )?")
        else:
            parts.append(f" (?:{item}) ")
    return "".join(parts)


#: The places that every version of these rules has to find.
BASE = """
cc-by     1  cc       cc by
gpl       1  licen    general public license
reserved  1  reserved all rights reserved
"""

#: Hand-written signatures, one a line.
SIGNATURES = """
gpl            2 gnu        gnu gpl
gpl            2 gpl        gpl licen[cs]ed?
gpl            2 gpl        licen[cs]ed? under ~the ~gnu gpl
gpl            2 gnu        gnu general public licen[cs]e
gpl-1.0        3 gpl        gpl ~version v?1 ~0
gpl-1.0        3 gnu        gnu general public licen[cs]e ~as ~published ..6 version 1 ~0
gpl-2.0        3 gpl        gpl ~version v?2 ~0
gpl-2.0        3 gplv2      gplv2
gpl-2.0        3 gnu        gnu general public licen[cs]e ~as ~published ..6 version 2 ~0
gpl-2.0        3 gnu        gnu general public licen[cs]e v2
gpl-2.0        3 licen      https? www gnu org licenses old licenses gpl 2 0 ..2
gpl-3.0        3 gpl        gpl ~version v?3 ~0
gpl-3.0        3 gplv3      gplv3
gpl-3.0        3 gnu        gnu general public licen[cs]e ~as ~published ..6 version 3 ~0
gpl-3.0        3 gnu        gnu general public licen[cs]e v3
gpl-3.0        3 licen      https? www gnu org licenses gpl 3 0 ..2
gpl-or-later   4 gnu        redistribute it and or modify it under the terms of the gnu general public licen[cs]e as published by the free software foundation either version [123] of the licen[cs]e or at your option any later version
gpl-warranty   4 gnu        without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public licen[cs]e
gpl-copy       4 gnu        you should have received a copy of the gnu general public licen[cs]e
lgpl           2 lesser     gnu lesser general public licen[cs]e
lgpl           2 lesser     lesser general public licen[cs]e
lgpl           2 library    gnu library general public licen[cs]e
lgpl           2 lgpl       lgpl licen[cs]ed?
lgpl-2.0       3 lgpl       lgpl ~version v?2 0
lgpl-2.0       3 library    gnu library general public licen[cs]e ..6 version 2 ~0
lgpl-2.1       3 lgpl       lgpl ~version v?2 1
lgpl-2.1       3 lgplv2     lgplv2 1
lgpl-2.1       3 lesser     gnu lesser general public licen[cs]e ..6 version 2 1
lgpl-3.0       3 lgpl       lgpl ~version v?3 ~0
lgpl-3.0       3 lgplv3     lgplv3
lgpl-3.0       3 lesser     gnu lesser general public licen[cs]e ..6 version 3 ~0
agpl           2 affero     gnu affero general public licen[cs]e
agpl           2 affero     affero general public licen[cs]e
agpl-1.0       3 affero     affero general public licen[cs]e ..3 version 1 ~0
agpl-3.0       3 affero     gnu affero general public licen[cs]e ..6 version 3 ~0
agpl-3.0       3 agpl       agpl ~version v?3 ~0
agpl-3.0       3 agplv3     agplv3
gfdl           2 documentation gnu free documentation licen[cs]e
gfdl-1.1       3 documentation gnu free documentation licen[cs]e version 1 1
gfdl-1.2       3 documentation gnu free documentation licen[cs]e version 1 2
gfdl-1.3       3 documentation gnu free documentation licen[cs]e version 1 3
gfdl           4 documentation copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
apache         2 apache     apache software licen[cs]e
apache         2 apache     apache licen[cs]e
apache         2 apache     apache licen[cs]ed
apache-1.0     3 apache     apache ~software licen[cs]e ~version 1 0
apache-1.1     3 apache     apache ~software licen[cs]e ~version 1 1
apache-2.0     3 apache     apache ~software licen[cs]e ~version v?2 ~0
apache-2.0     3 apache     apache 2 0 ~licen[cs]e
apache-2.0     3 apache     asl 2 0 apache
apache-2.0     3 apache     https? www apache org licenses license 2 0 ~txt
apache-2.0     4 apache     licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0     4 licen      unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
mit            2 licen      mit licen[cs]ed?
mit            2 licen      licen[cs]ed? under ~the mit ~licen[cs]e
mit            2 licen      expat licen[cs]e
mit            3 opensource https? ~www opensource org licenses mit ..2
mit            4 permission permission is hereby granted free of charge to any person obtaining a copy
mit            4 permission the above copyright notice and this permission notice shall be included in all copies or substantial portions
mit            4 warrant    the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
x11            2 licen      x11 licen[cs]e
mit-0          3 licen      mit no attribution ~licen[cs]e
bsd            2 bsd        bsd licen[cs]ed?
bsd            2 bsd        bsd style licen[cs]ed?
bsd            2 berkeley   berkeley software distribution ~licen[cs]e
bsd-0-clause   3 bsd        bsd zero clause ~licen[cs]e
bsd-0-clause   3 bsd        0 ?clause bsd ~licen[cs]e
bsd-2-clause   3 bsd        bsd 2 clause ~licen[cs]e
bsd-2-clause   3 bsd        (?:2|two) clause bsd ~licen[cs]e
bsd-2-clause   3 bsd        simplified bsd licen[cs]e
bsd-2-clause   3 bsd        freebsd licen[cs]e
bsd-3-clause   3 bsd        bsd 3 clause ~licen[cs]e
bsd-3-clause   3 bsd        (?:3|three) clause bsd ~licen[cs]e
bsd-3-clause   3 bsd        (?:new|revised|modified) bsd licen[cs]e
bsd-4-clause   3 bsd        bsd 4 clause ~licen[cs]e
bsd-4-clause   3 bsd        (?:original|old) bsd licen[cs]e
bsd            4 redistribut redistribution and use in source and binary forms with or without modification are permitted
bsd            4 redistribut redistributions of source code must retain the above copyright notice
bsd            4 redistribut redistributions in binary form must reproduce the above copyright notice
bsd-3-clause   4 endorse    neither the name of ..12 may be used to endorse or promote products derived from this software
bsd-4-clause   4 advertising all advertising materials mentioning features or use of this software must display
isc            2 isc        isc licen[cs]ed?
isc            4 permission permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl            2 mozilla    mozilla public licen[cs]e
mpl-1.0        3 mozilla    mozilla public licen[cs]e ~version v?1 0
mpl-1.1        3 mozilla    mozilla public licen[cs]e ~version v?1 1
mpl-1.1        3 mpl        mpl ~version v?1 1
mpl-2.0        3 mozilla    mozilla public licen[cs]e ~version v?2 ~0
mpl-2.0        3 mpl        mpl ~version v?2 ~0
mpl-2.0        3 mozilla    https? ~www mozilla org mpl 2 0 ..1
mpl-2.0        4 mozilla    this source code form is subject to the terms of the mozilla public license v 2 0
epl            2 eclipse    eclipse public licen[cs]e
epl-1.0        3 eclipse    eclipse public licen[cs]e ~version v?1 ~0
epl-2.0        3 eclipse    eclipse public licen[cs]e ~version v?2 ~0
epl-1.0        3 eclipse    https? www eclipse org legal epl v10 ..1
epl-2.0        3 eclipse    https? www eclipse org legal epl (?:2|v20) ..1
edl-1.0        3 eclipse    eclipse distribution licen[cs]e ~version ~v?1 ~0
cddl           2 cddl       cddl ~licen[cs]ed?
cddl           2 development common development and distribution licen[cs]e
cddl-1.0       3 development common development and distribution licen[cs]e ..2 version 1 0
cddl-1.1       3 development common development and distribution licen[cs]e ..2 version 1 1
cpl-1.0        3 licen      common public licen[cs]e ~version ~v?1 ~0
ipl-1.0        2 licen      ibm public licen[cs]e
eupl           2 european   european union public licen[cs]e
eupl-1.1       3 european   european union public licen[cs]e ~version v?1 1
eupl-1.2       3 european   european union public licen[cs]e ~version v?1 2
artistic       2 artistic   artistic licen[cs]e
artistic-1.0   3 artistic   artistic licen[cs]e ~version v?1 ~0
artistic-2.0   3 artistic   artistic licen[cs]e ~version v?2 ~0
artistic       3 perl       same terms as perl itself
boost          2 boost      boost software licen[cs]e
boost-1.0      3 boost      boost software licen[cs]e ~version 1 0
boost-1.0      3 boost      https? www boost org license 1 0 ~txt
zlib           2 zlib       zlib licen[cs]ed?
zlib           2 zlib       zlib libpng licen[cs]e
zlib           4 warrant    this software is provided as is without any express or implied warranty in no event will the authors be held liable
libpng         2 libpng     libpng licen[cs]e
openssl        2 openssl    openssl licen[cs]e
openssl        4 openssl    this product includes software developed by the openssl project
python         2 python     python software foundation licen[cs]e
python         2 python     psf licen[cs]e ..2 python
php            2 php        php licen[cs]e
php-3.0        3 php        php licen[cs]e ~version v?3 0 ~1
ruby           2 ruby       ruby licen[cs]e
ruby           3 ruby       same terms as ruby ~itself
w3c            2 w3c        w3c software ..4 licen[cs]e
unicode        2 unicode    unicode licen[cs]e ~agreement
unicode        2 unicode    unicode terms of use
ncsa           2 illinois   university of illinois ..1 ncsa open source licen[cs]e
ncsa           2 ncsa       ncsa ~open ~source licen[cs]e
postgresql     2 postgresql postgresql licen[cs]e
ofl            2 sil        sil open font licen[cs]e
ofl-1.1        3 sil        sil open font licen[cs]e ~version 1 1
ofl            2 font       open font licen[cs]e
lppl           2 latex      latex project public licen[cs]e
lppl-1.3c      3 latex      latex project public licen[cs]e ..8 version 1 3c?
ms-pl          2 microsoft  microsoft public licen[cs]e
ms-rl          2 microsoft  microsoft reciprocal licen[cs]e
odbl           2 database   open database licen[cs]e
odbl           2 odbl       odbl ~v?1 ~0
odc-by         2 commons    open data commons attribution licen[cs]e
pddl           2 commons    open data commons public domain dedication ..3
osl-3.0        3 licen      open software licen[cs]e ~version v?3 ~0
afl-3.0        3 academic   academic free licen[cs]e ~version v?3 ~0
afl            2 academic   academic free licen[cs]e
qpl            2 licen      q public licen[cs]e
wtfpl          2 wtfpl      wtfpl
wtfpl          4 licen      do what the fuck you want to public licen[cs]e
unlicense      2 unlicense  unlicense
unlicense      3 unlicense  https? ~www unlicense org ..1
unlicense      4 domain     this is free and unencumbered software released into the public domain
beerware       2 beer       beer ?ware licen[cs]e
beerware       4 beer       as long as you retain this notice you can do whatever you want with this stuff
json           4 evil       the software shall be used for good not evil
sspl-1.0       3 licen      server side public licen[cs]e ~version ~v?1 ~0
elastic-2.0    3 elastic    elastic licen[cs]e ~version v?2 ~0
busl-1.1       3 licen      business source licen[cs]e ~version ~1 ~1
commons-clause 3 commons    commons clause licen[cs]e ~condition
llama          2 llama      llama [234]? ~[0-9] community licen[cs]e
openrail       2 openrail   openrail ~m ~licen[cs]e
public-domain  1 domain     public domain
public-domain  3 domain     (?:placed|dedicated|released) (?:in|to|into) the public domain
public-domain  3 domain     in the public domain
cc0            3 cc0        cc0 ~1 ~0 ~universal
cc0            3 commons    creative commons zero ~v?1 ~0 ~universal
cc0            3 publicdomain https? creativecommons org publicdomain zero 1 0 ..1
cc-mark        3 publicdomain https? creativecommons org publicdomain mark 1 0 ..1
cc0            4 waive      to the extent possible under law ..8 waived all copyright and related or neighboring rights
creative-commons 1 commons  creative commons
creative-commons 2 commons  creative commons licen[cs]ed?
creative-commons 1 creativecommons creativecommons org licenses ..1
copyright      1 copyright  copyright c ..1 [12][0-9]{3}
copyright      1 copyright  copyright © ..1 [12][0-9]{3}
copyright      1 copyright  copyright [12][0-9]{3}
copyright      1 copyright  copyrighted ~material ~by
copyright      1 ©          © [12][0-9]{3}
reserved       2 reserved   some rights reserved
reserved       2 reserved   no rights reserved
reserved       2 reserved   alle rechte vorbehalten
reserved       2 vorbehalten alle rechte vorbehalten
reserved       2 réservés   tous droits réservés
reserved       2 reservados todos los derechos reservados
proprietary    2 proprietary proprietary and confidential
proprietary    2 confidential confidential and proprietary
proprietary    3 prohibited unauthorized (?:copying|use|reproduction|distribution) ..8 is strictly prohibited
proprietary    3 permission no part of this (?:publication|book|document|work) may be reproduced ..20 without ~the ~prior ~written permission
proprietary    3 consent    may not be (?:reproduced|copied|distributed) ..8 without ~the ~express ~prior ~written consent
proprietary    2 licen      end user licen[cs]e agreement
proprietary    2 eula       eula
trademark      1 trademark  (?:registered )?trademarks?
trademark      2 trademark  (?:is|are) ~a registered trademarks? of
no-warranty    2 warrant    provided as is ..2 without ~any warranty
no-warranty    2 warrant    without warrant(?:y|ies) of any kind
no-liability   2 liab       in no event shall ..14 be liable
permission     1 permission (?:used|reprinted|reproduced) (?:with|by) ~kind permission
permission     1 permission with ~the ~prior ~written permission of
terms          1 terms      terms (?:of|and) (?:use|service|conditions)
noncommercial  1 commercial (?:for|non) ~non ~commercial (?:use|purposes?) only
noncommercial  2 noncommercial noncommercial use only
noncommercial  2 commercial non commercial use only
academic       1 academic   for academic (?:use|purposes?|research) ~only
open-source    1 licen      open source licen[cs]ed?
open-source    1 licen      osi approved ..2 licen[cs]e
free-software  1 foundation free software foundation
free-software  1 freedom    this is free software
attribution    1 attribution attribution required
share-alike    1 share      share ?alike
no-derivatives 1 deriv      no ?derivatives?
no-derivatives 1 deriv      no derivative works
"""

#: Identifiers of the public licence list, tagged in files by 'SPDX-License-Identifier:'.
TAGS = """
0BSD AFL-2.1 AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 BlueOak-1.0.0
BSD-1-Clause BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 BUSL-1.1 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0
CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.1 CPL-1.0 ECL-2.0 EPL-1.0 EPL-2.0
EUPL-1.1 EUPL-1.2 GFDL-1.3 GPL-1.0-only GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC
LGPL-2.0-only LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PDDL-1.0 PostgreSQL Python-2.0 Ruby Unicode-DFS-2016 Unlicense
UPL-1.0 Vim W3C WTFPL X11 Zlib
"""

#: Elements of the Creative Commons licences and the words of their names.
ELEMENTS = {
    "by": "attribution",
    "by-sa": "attribution share ?alike",
    "by-nd": "attribution no ?deriv(?:ative)?s?",
    "by-nc": "attribution non ?commercial",
    "by-nc-sa": "attribution non ?commercial share ?alike",
    "by-nc-nd": "attribution non ?commercial no ?deriv(?:ative)?s?",
}
VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


def _words(dotted: str) -> str:
    return " ".join(dotted.lower().replace(".", " ").replace("-", " ").split())


def _lines(table: str, base: bool = False) -> list[Rule]:
    out = []
    for line in table.strip().splitlines():
        label, priority, keyword, pattern = line.split(None, 3)
        out.append(Rule(label, int(priority), keyword, _joined(pattern), base))
    return out


def _joined(pattern: str) -> str:
    """'x ?y' (one word or two) becomes an alternative of both forms."""
    regex, parts = "", pattern.split()
    k = 0
    while k < len(parts):
        if k + 1 < len(parts) and parts[k + 1].startswith("?"):
            rest = parts[k + 1][1:]
            regex += f"(?: (?:{parts[k]}{rest}) | (?:{parts[k]})  (?:{rest}) )"
            k += 2
        else:
            regex += compiled(parts[k])
            k += 1
    return regex


def _tags() -> list[Rule]:
    return [Rule(t.lower(), 4, "spdx", compiled(f"spdx license identifier {_words(t)}")) for t in TAGS.split()]


def _commons() -> list[Rule]:
    out = []
    for code, name in ELEMENTS.items():
        out.append(Rule(f"cc-{code}", 2, "cc", compiled(f"cc {_words(code)}")))
        out.append(Rule(f"cc-{code}", 2, "commons", _joined(f"creative commons {name}")))
        for v in VERSIONS:
            number = _words(v)
            out.append(Rule(f"cc-{code}-{v}", 3, "cc", compiled(f"cc {_words(code)} v?{number}")))
            out.append(Rule(f"cc-{code}-{v}", 3, "commons", _joined(f"creative commons {name} ~licen[cs]e ~version ~international {number}")))
            out.append(Rule(f"cc-{code}-{v}", 3, "creativecommons", compiled(f"https? creativecommons org licenses {_words(code)} {number}")))
    return out


def rules() -> list[Rule]:
    """All rules; a rule's place in the list is its number."""
    return _lines(BASE, base=True) + _lines(SIGNATURES) + _commons() + _tags()
