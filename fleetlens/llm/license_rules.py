"""Signature rules for license texts, notices and mentions.

Each line: label | priority | keywords | pattern. Patterns match lower-cased words with one blank between them. A rule is
tried where all its keywords stand; for wordings of the pattern that do without one of them, `gates` adds the words that
such a wording must hold. Priority
1: a license's own wording or a full name; 2: a notice that refers to one; 3: a mention; 4: a hint that needs a reader.
"""

from __future__ import annotations

from itertools import product
from re import _constants as op
from re import _parser

#: How sure a detection of each priority is.
CONFIDENCE = {0: 1.0, 1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}

RULES = r"""
gpl-3.0 | 1 | gnu general version | gnu general public license version 3( or later| or any later version)?
gpl-3.0 | 1 | gplv3 | gplv3( or later)?
gpl-3.0 | 2 | gpl | gpl (version |v )?3( 0)?( only| or later)?
gpl-3.0 | 1 | gnu general 29 | gnu general public license version 3 29 june 2007
gpl-2.0 | 1 | gnu general version | gnu general public license version 2( or later| or any later version)?
gpl-2.0 | 1 | gplv2 | gplv2( or later)?
gpl-2.0 | 2 | gpl | gpl (version |v )?2( 0)?( only| or later)?
gpl-2.0 | 1 | gnu general 1991 | gnu general public license version 2 june 1991
gpl-1.0 | 1 | gnu general version | gnu general public license version 1( or later| or any later version)?
gpl | 1 | gnu general | gnu general public license
gpl | 2 | free redistribute modify | this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl | 2 | fitness warranty gnu | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
gpl | 2 | copy gnu | you should have received a copy of the gnu general public license
gpl | 2 | gpl | (licensed|released|distributed|available) under the (terms of the )?(gnu )?gpl
gpl | 3 | gpl | (gnu )?gpl
gpl | 3 | gnu licenses | www gnu org licenses( gpl( html)?)?
lgpl-3.0 | 1 | gnu lesser version | gnu lesser general public license version 3( or later)?
lgpl-3.0 | 1 | lgplv3 | lgplv3( or later)?
lgpl-3.0 | 2 | lgpl | lgpl (version |v )?3( 0)?( only| or later)?
lgpl-2.1 | 1 | gnu lesser version | gnu lesser general public license version 2 1( or later| or any later version)?
lgpl-2.1 | 2 | lgpl | lgpl (version |v )?2 1( only| or later)?
lgpl-2.0 | 1 | gnu library version | gnu library general public license version 2( or later)?
lgpl-2.0 | 1 | gnu library | gnu library general public license
lgpl | 1 | gnu lesser | gnu lesser general public license
lgpl | 2 | lgpl | (licensed|released|distributed|available) under the (terms of the )?(gnu )?lgpl
lgpl | 3 | lgpl | (gnu )?lgpl
lgpl | 2 | copy lesser | you should have received a copy of the gnu (lesser|library) general public license
agpl-3.0 | 1 | gnu affero version | gnu affero general public license version 3( or later)?
agpl-3.0 | 1 | agplv3 | agplv3( or later)?
agpl-3.0 | 2 | agpl | agpl (version |v )?3( 0)?( only| or later)?
agpl-1.0 | 1 | affero version | affero general public license version 1
agpl | 1 | affero | (gnu )?affero general public license
agpl | 3 | agpl | (gnu )?agpl
gfdl-1.3 | 1 | gnu documentation version | gnu free documentation license version 1 3( or later)?
gfdl-1.2 | 1 | gnu documentation version | gnu free documentation license version 1 2( or later)?
gfdl-1.1 | 1 | gnu documentation version | gnu free documentation license version 1 1( or later)?
gfdl | 1 | gnu documentation | gnu free documentation license
gfdl | 2 | invariant | with no invariant sections no front cover texts and no back cover texts
gfdl | 3 | gfdl | (gnu )?gfdl
apache-2.0 | 1 | apache version | (the )?apache license version 2 0
apache-2.0 | 1 | apache | apache (software )?license (v )?2( 0)?
apache-2.0 | 2 | apache licensed | licensed under the apache license version 2 0( the license)?
apache-2.0 | 2 | apache | you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0
apache-2.0 | 3 | apache licenses | www apache org licenses license 2 0( html| txt)?
apache-2.0 | 4 | compliance license | you may not use this file except in compliance with the license
apache-1.1 | 1 | apache version | (the )?apache (software )?license version 1 1
apache-1.0 | 1 | apache version | (the )?apache (software )?license version 1 0
apache | 3 | apache | apache (software )?license
apache | 2 | apache asf | licensed to the apache software foundation asf under one or more contributor license agreements
mit | 1 | permission granted charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files( the software)?( to deal in the software without restriction)?
mit | 1 | deal restriction | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | 2 | copyright notice permission substantial | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | 2 | mit licensed | licensed under (the )?(terms of the )?mit( license)?
mit | 2 | mit released | (released|distributed|available) under (the )?(terms of the )?mit( license)?
mit | 1 | mit | (the )?mit license( mit)?
mit | 3 | expat | (the )?expat license
mit | 3 | opensource mit | opensource org licenses mit( license)?( php)?
mit-0 | 1 | mit attribution | mit no attribution( license)?
mit-modern | 1 | mit modern | mit license modern variant
x11 | 1 | x11 | (the )?x11 license
x11 | 2 | consortium | the x consortium be liable
bsd-2-clause | 1 | bsd | (the )?bsd 2 clause( simplified| license)*
bsd-2-clause | 1 | bsd simplified | simplified bsd license
bsd-2-clause | 1 | freebsd | freebsd (license|documentation license)
bsd-3-clause | 1 | bsd | (the )?bsd 3 clause( new| revised| license)*
bsd-3-clause | 1 | bsd new | (new|modified|revised) bsd license
bsd-3-clause | 2 | neither endorse | neither the name of (the )?[^ ]+( [^ ]+){0,8} nor the names of its contributors may be used to endorse or promote products
bsd-4-clause | 1 | bsd | (the )?bsd 4 clause( original| license)*
bsd-4-clause | 2 | advertising materials | all advertising materials mentioning features or use of this software must display
bsd | 1 | redistribution source binary | redistribution and use in source and binary forms with or without modification are permitted( provided that the following conditions are met)?
bsd | 2 | redistributions source | redistributions of source code must retain the (above )?copyright notice( this list of conditions and the following disclaimer)?
bsd | 2 | redistributions binary | redistributions in binary form must reproduce the (above )?copyright notice
bsd | 2 | bsd licensed | (licensed|released|distributed|available) under (the )?(terms of the )?bsd( style)? license
bsd | 3 | bsd | bsd( style| like)? license
bsd-0-clause | 1 | bsd | (bsd zero clause( license)?|0bsd|zero clause bsd)
isc | 1 | isc | (the )?isc license( isc)?
isc | 1 | permission use copy hereby | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted( provided that the above copyright notice and this permission notice appear in all copies)?
isc | 3 | isc licensed | licensed under (the )?isc
mpl-2.0 | 1 | mozilla version | mozilla public license (version |v )?2 0
mpl-2.0 | 2 | mozilla source form | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | 3 | mozilla | mozilla org mpl 2 0
mpl-1.1 | 1 | mozilla version | mozilla public license (version |v )?1 1
mpl-1.0 | 1 | mozilla version | mozilla public license (version |v )?1 0
mpl | 1 | mozilla | mozilla public license
mpl | 3 | mpl | mpl( [12] [01])?
epl-2.0 | 1 | eclipse | eclipse public license( version| v)? 2 0
epl-1.0 | 1 | eclipse | eclipse public license( version| v)? 1 0
epl | 1 | eclipse | eclipse public license
edl-1.0 | 1 | eclipse distribution | eclipse distribution license( version| v)?( 1 0)?
cpl-1.0 | 1 | common public | common public license( version| v)?( 1 0)?
cddl-1.1 | 1 | cddl | cddl( version)? 1 1
cddl-1.0 | 1 | common development distribution | common development and distribution license( cddl)?( version)?( 1 0)?
cddl | 3 | cddl | cddl
ipl-1.0 | 1 | ibm public | ibm public license( version)?( 1 0)?
spl-1.0 | 1 | sun public | sun public license( version)?( 1 0)?
bcl | 1 | oracle binary | oracle binary code license( agreement)?
otn | 1 | oracle technology network | oracle technology network license( agreement)?
upl-1.0 | 1 | universal permissive | universal permissive license( v)?( 1 0)?
artistic-2.0 | 1 | artistic | artistic license( version)? 2 0
artistic-1.0 | 1 | artistic | artistic license( version)? 1 0
artistic | 1 | artistic | (the )?artistic license
perl | 2 | perl same terms | (under the )?same terms as perl( itself)?
psf-2.0 | 1 | python foundation | python software foundation license( version 2)?
python | 3 | python | python license
ruby | 1 | ruby | (the )?ruby license|under the same terms as ruby
php-3.01 | 1 | php | php license( version)? 3 01
php-3.0 | 1 | php | php license( version)? 3 0
php | 3 | php | (the )?php license
zlib | 1 | zlib | (the )?zlib( libpng)? license
zlib | 1 | altered misrepresented | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | 2 | origin misrepresented | the origin of this software must not be misrepresented
libpng | 1 | libpng | libpng license( version 2)?
bzip2 | 1 | bzip2 | bzip2( and libbzip2)? license
openssl | 1 | openssl | openssl (license|toolkit)
ssleay | 1 | ssleay | ssleay license
curl | 1 | curl | curl license
boost-1.0 | 1 | boost | boost software license( version)?( 1 0)?
boost-1.0 | 3 | boost licence | boost org license 1 0 txt
wtfpl | 1 | wtfpl | (the )?wtfpl( version 2)?
wtfpl | 1 | fuck | do what the fuck you want to( public license)?
unlicense | 1 | unlicense | (the )?unlicense
unlicense | 1 | unencumbered public | this is free and unencumbered software released into the public domain
public-domain | 2 | public domain | (released|placed|dedicated) (in|into|to) the public domain
public-domain | 3 | public domain | public domain
cc0-1.0 | 1 | cc0 | cc0( 1 0)?( universal)?
cc0-1.0 | 1 | creative zero | creative commons zero( v?1 0)?( universal)?
cc0-1.0 | 3 | publicdomain zero | creativecommons org publicdomain zero 1 0
cc-by-4.0 | 1 | creative attribution international | creative commons attribution 4 0( international)?( license)?
cc-by-3.0 | 1 | creative attribution | creative commons attribution 3 0( unported)?( license)?
cc-by-2.5 | 1 | creative attribution | creative commons attribution 2 5( generic)?( license)?
cc-by-2.0 | 1 | creative attribution | creative commons attribution 2 0( generic)?( license)?
cc-by-4.0 | 2 | cc | cc by 4 0
cc-by-3.0 | 2 | cc | cc by 3 0
cc-by-2.5 | 2 | cc | cc by 2 5
cc-by-2.0 | 2 | cc | cc by 2 0
cc-by-sa-4.0 | 1 | creative sharealike | creative commons attribution share ?alike 4 0( international)?( license)?
cc-by-sa-3.0 | 1 | creative sharealike | creative commons attribution share ?alike 3 0( unported)?( license)?
cc-by-sa-4.0 | 2 | cc sa | cc by sa 4 0
cc-by-sa-3.0 | 2 | cc sa | cc by sa 3 0
cc-by-sa-2.5 | 2 | cc sa | cc by sa 2 5
cc-by-sa | 2 | cc sa | cc by sa
cc-by-nc-4.0 | 1 | creative noncommercial | creative commons attribution non ?commercial 4 0( international)?( license)?
cc-by-nc-4.0 | 2 | cc nc | cc by nc 4 0
cc-by-nc-3.0 | 2 | cc nc | cc by nc 3 0
cc-by-nc | 2 | cc nc | cc by nc
cc-by-nd-4.0 | 1 | creative noderivatives | creative commons attribution no ?deriv(ative)?s 4 0( international)?( license)?
cc-by-nd-4.0 | 2 | cc nd | cc by nd 4 0
cc-by-nd | 2 | cc nd | cc by nd
cc-by-nc-sa-4.0 | 1 | creative noncommercial sharealike | creative commons attribution non ?commercial share ?alike 4 0( international)?( license)?
cc-by-nc-sa-4.0 | 2 | cc nc sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | 2 | cc nc sa | cc by nc sa 3 0
cc-by-nc-sa | 2 | cc nc sa | cc by nc sa
cc-by-nc-nd-4.0 | 2 | cc nc nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | 2 | cc nc nd | cc by nc nd 3 0
cc-by-nc-nd | 2 | cc nc nd | cc by nc nd
cc | 2 | creative commons licensed | licensed under (a |the )?creative commons( [^ ]+){0,6} license
cc | 3 | creative commons | creative commons( license)?
cc | 3 | creativecommons | creativecommons org licenses [^ ]+( [^ ]+){0,4}
odbl-1.0 | 1 | open database | open database license( odbl)?( v)?( 1 0)?
odc-by-1.0 | 1 | open data commons | open data commons attribution license( v)?( 1 0)?
pddl-1.0 | 1 | open data commons | (open data commons )?public domain dedication and licen[cs]e( pddl)?( v)?( 1 0)?
cdla-permissive-1.0 | 1 | community data | community data license agreement permissive( version)? 1 0
cdla-permissive-2.0 | 1 | community data | community data license agreement permissive( version)? 2 0
cdla-sharing-1.0 | 1 | community data | community data license agreement sharing( version)?( 1 0)?
ogl-3.0 | 1 | open government | open government licen[cs]e( v| version)? 3( 0)?
ogl-2.0 | 1 | open government | open government licen[cs]e( v| version)? 2( 0)?
ogl | 1 | open government | open government licen[cs]e
ofl-1.1 | 1 | sil | sil open font license( version)?( 1 1)?
ofl-1.1 | 3 | ofl | (the )?ofl( 1 1)?
eupl-1.2 | 1 | european union | european union public licen[cs]e( eupl)?( v| version)? 1 2
eupl-1.1 | 1 | european union | european union public licen[cs]e( eupl)?( v| version)? 1 1
eupl | 1 | european union | european union public licen[cs]e
cecill-2.1 | 1 | cecill | cecill( free software license agreement)?( version)? 2 1
cecill-b | 1 | cecill | cecill b( license)?
cecill-c | 1 | cecill | cecill c( license)?
cecill | 1 | cecill | cecill( license)?
mulan-2.0 | 1 | mulan | mulan (psl|permissive software license)( v| version)?( ?2)?
ms-pl | 1 | microsoft | microsoft public license( ms pl)?
ms-rl | 1 | microsoft reciprocal | microsoft reciprocal license( ms rl)?
ms-eula | 2 | microsoft license terms | microsoft software license terms
apsl-2.0 | 1 | apple source | apple public source license( version)?( 2 0)?
nasa-1.3 | 1 | nasa | nasa open source agreement( version)?( 1 3)?
ncsa | 1 | ncsa | (university of illinois )?ncsa open source license
osl-3.0 | 1 | open software | open software license( v| version)? 3 0
osl-2.1 | 1 | open software | open software license( v| version)? 2 1
afl-3.0 | 1 | academic | academic free license( v| version)? 3 0
afl | 1 | academic | academic free license
ecl-2.0 | 1 | educational | educational community license( version)?( 2 0)?
lppl-1.3 | 1 | latex | latex project public license( version)?( 1 3c?)?
qpl-1.0 | 1 | q public | q public license( version)?( 1 0)?
sleepycat | 1 | sleepycat | sleepycat (software|license)
postgresql | 1 | postgresql | postgresql licen[cs]e
sqlite-blessing | 1 | blessing | in place of a legal notice here is a blessing
vim | 1 | vim | vim license
w3c | 1 | w3c | w3c software( notice and)?( document)? license
unicode | 1 | unicode | unicode( inc)? license agreement( data files and software)?
beerware | 1 | beer | (the )?beer ?ware license
json | 1 | evil | the software shall be used for good not evil
hpnd | 1 | historical permission | historical permission notice and disclaimer
ntp | 1 | ntp | ntp license
fair | 1 | fair usage | usage of the works is permitted provided that this instrument is retained with the works
naumen | 1 | naumen | naumen public license
zpl-2.1 | 1 | zope | zope public license( zpl)?( version)?( 2 1)?
sspl-1.0 | 1 | server side | server side public license( v| version)?( 1)?
bsl-1.1 | 1 | business | business source license( version)?( 1 1)?
elastic-2.0 | 1 | elastic | elastic license( version)?( 2 0)?
commons-clause | 1 | commons clause | commons clause( license condition)?( v?1 0)?
polyform | 1 | polyform | polyform (noncommercial|small business|shield|strict|internal use)( license)?( 1 0 0)?
rail | 1 | rail | (creativeml |bigscience |bloom )?(open ?)?rail( m| license)*
llama | 1 | llama | llama [23]( 1)? community license( agreement)?
gemma | 1 | gemma | gemma terms of use
proprietary | 2 | confidential proprietary | confidential and proprietary( information)?
proprietary | 2 | proprietary | proprietary license
proprietary | 2 | trade secrets | contains (confidential information and )?trade secrets of
proprietary | 3 | unauthorized copying | unauthorized copying of this (file|software|document|work)
proprietary | 3 | reproduction prohibited | (reproduction|redistribution|copying|duplication)( [^ ]+){0,6} (is )?(strictly )?prohibited
proprietary | 3 | permission reproduced | may not be (copied|reproduced|published|redistributed|rewritten)( [^ ]+){0,8} without( [^ ]+){0,4} permission
proprietary | 3 | rights copyright | all rights are reserved
eula | 2 | end user license | end user licen[cs]e agreement
eula | 3 | eula | eula
terms-of-use | 3 | terms use | terms of (use|service)
terms-of-use | 4 | terms conditions | terms and conditions
noncommercial | 3 | commercial | for (non ?commercial|personal) use( only)?
noncommercial | 3 | commercial | not for commercial use
academic-use | 3 | academic research | for (academic|research)( and| or)?( academic| research| educational)? (use|purposes)( only)?
evaluation | 3 | evaluation | for evaluation purposes( only)?
warranty-disclaimer | 3 | warranty | the software is provided as is without warranty of any kind( express or implied)?
warranty-disclaimer | 4 | warranties | (disclaims?|without) (any|all) warranties( [^ ]+){0,6}
warranty-disclaimer | 4 | merchantability fitness | merchantability (and|or) fitness for a particular purpose
liability | 4 | liable event | in no event shall( [^ ]+){0,12} be liable
copyright | 3 | copyright | copyright (c )?(19|20)[0-9]{2}( (19|20)[0-9]{2})*
copyright | 4 | copyright | copyright (notice|holders?|owners?)
copyright | 4 | copyrighted | copyrighted (material|work|content)
dual-license | 3 | dual licensed | dual licensed( under)?
dual-license | 3 | choice license | at your (choice|option)( under)?( either)? (license|any later version)
spdx | 2 | spdx identifier | spdx license identifier [^ ]+( [^ ]+){0,3}
see-license | 4 | license file | see (the )?(license|licence|copying)( md| txt)?( file)?( for)?
license-mention | 4 | licensed | licensed under( the)? [^ ]+
license-mention | 4 | license | (open source|free software|software) license
"""


#: Stands for characters that a pattern leaves open, blanks among them.
OPEN = "\0"


def wordings(pattern: str) -> set[str]:
    """Every text that a pattern matches is one of these, with any characters in place of OPEN."""

    def each(tree) -> set[str]:
        return {"".join(x) for x in product(*(piece(*p) for p in tree))}

    def piece(kind, arg) -> set[str]:
        if kind is op.LITERAL:
            return {chr(arg)}
        if kind is op.SUBPATTERN:
            return each(arg[-1])
        if kind is op.BRANCH:
            return set().union(*map(each, arg[1]))
        if kind is op.IN and all(k is op.LITERAL for k, _ in arg):
            return {chr(c) for _, c in arg}
        if kind is op.MAX_REPEAT:
            least, most, inner = arg
            one = each(inner)
            out = {"".join(x) for x in product(one, repeat=least)}
            more = one if most == least + 1 else {x + OPEN for x in one}
            return out | {a + b for a in out for b in more} if most > least else out
        return {OPEN}

    return each(_parser.parse(pattern))


def gates(keywords: list[str], pattern: str) -> list[list[str]]:
    """Sets of words, one of which stands whole in every text that the pattern matches."""
    out: set[frozenset[str]] = set()
    for w in wordings(pattern):
        words = frozenset(x for x in w.split() if OPEN not in x)
        out.add(frozenset(keywords) if words.issuperset(keywords) else words)
    return sorted(sorted(g) for g in out if not any(g > other for other in out))


def parsed() -> list[tuple[str, int, list[list[str]], str]]:
    """(label, priority, gates, pattern) in the order they stand, which resolves ties."""
    out = []
    for line in RULES.strip().splitlines():
        label, priority, keywords, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append((label, int(priority), gates(keywords.split(), pattern), pattern))
    return out
