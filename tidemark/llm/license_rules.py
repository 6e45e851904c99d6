"""Ordered signature rules of the license scan, written by hand, one a line as ``label: words``.

The words of a rule stand one after another in the text's words (letters, digits and non-ASCII,
lower-cased).  ``a/b`` is either word, ``x?`` a word that may be missing, ``*`` any one word; other
signs are a regular expression for one word.  Sections are in falling order of priority, and within
a section an earlier rule goes before a later one.
"""

from __future__ import annotations

#: Sentences of license texts and grants.
NOTICE = """
mit: permission is hereby granted free of charge to any person obtaining a copy of this software
mit: to deal in the software without restriction including without limitation the rights to use copy modify
mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit-0: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software
isc: permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted provided
0bsd: permission to use copy modify and or? distribute this software for any purpose with or without fee is hereby granted the
hpnd: permission to use copy modify and distribute this software and its documentation for any purpose
ntp: permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted
bsd-2-clause: redistribution and use in source and binary forms with or without modification are permitted
bsd-3-clause: neither the name of the? * * * * * * may be used to endorse or promote products
bsd-3-clause: neither the name of the? * * may be used to endorse or promote products
bsd-3-clause: neither the name of * nor the names of its contributors may be used to endorse or promote products
bsd-3-clause: neither the name of the copyright holder nor the names of its contributors may be used to endorse
bsd-4-clause: all advertising materials mentioning features or use of this software must display the following acknowledgement
bsl-1.0: permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation
zlib: this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib: the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib: altered source versions must be plainly marked as such and must not be misrepresented
unlicense: this is free and unencumbered software released into the public domain
unlicense: anyone is free to copy modify publish use compile sell or distribute this software
wtfpl: everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed
wtfpl: you just do what the fuck you want to
gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
gpl-2.0-or-later: either version 2 of the license or at your option any later version
gpl-3.0-or-later: either version 3 of the license or at your option any later version
gpl: you should have received a copy of the gnu general public license
gpl: this program is distributed in the hope that it will be useful but without any warranty
gpl: the licenses for most software are designed to take away your freedom
lgpl: you should have received a copy of the gnu lesser/library general public license
lgpl: this library is free software you can redistribute it and or modify it under the terms of the gnu lesser/library general public license
lgpl-2.1-or-later: either version 2 1 of the license or at your option any later version
lgpl: this library is distributed in the hope that it will be useful but without any warranty
agpl: you should have received a copy of the gnu affero general public license
agpl: under the terms of the gnu affero general public license as published by the free software foundation
gfdl: permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
gfdl: with no invariant sections no front cover texts and no back cover texts
apache-2.0: licensed under the apache license version 2 0
apache-2.0: you may not use this file except in compliance with the license you may obtain a copy of the license at
apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-1.1: this product includes software developed by the apache software foundation
mpl-2.0: this source code form is subject to the terms of the mozilla public license v/version 2 0
mpl-2.0: if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0: the contents of this file are subject to the mozilla public license version 1 0
npl-1.1: the contents of this file are subject to the netscape public license version 1 1
epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license v/version? 2 0
epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public license v/version? 1 0
cpl-1.0: this program and the accompanying materials are made available under the terms of the common public license
cddl-1.0: the contents of this file are subject to the terms of the common development and distribution license
artistic: the intent of this document is to state the conditions under which a package may be copied
artistic-2.0: everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed preamble
ofl-1.1: this font software is licensed under the sil open font license
ofl-1.1: permission is hereby granted free of charge to any person obtaining a copy of the font software
cc0-1.0: the person who associated a work with this deed has dedicated the work to the public domain
cc0-1.0: to the extent possible under law * * has waived all copyright and related or neighboring rights
cc0-1.0: to the extent possible under law the author s? has/have dedicated all copyright
cc-by: you are free to share and adapt the material for any purpose even commercially
cc-by-sa: if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc: you may not use the material for commercial purposes
cc-by-nd: if you remix transform or build upon the material you may not distribute the modified material
vim: there are no restrictions on distributing unmodified copies of vim
openssl: this product includes software developed by the openssl project
php-3.01: this product includes php software freely available from
python-2.0: psf hereby grants licensee a nonexclusive royalty free world wide license
postgresql: permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
curl: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
ncsa: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction
x11: shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization
libpng: the png reference library is supplied as is
ijg: this software is based in part on the work of the independent jpeg group
beerware: if we meet some day and you think this stuff is worth it you can buy me a beer in return
json: the software shall be used for good not evil
ms-pl: if you use the software you accept this license if you do not accept the license do not use the software
eupl: licensed under the eupl
sspl-1.0: if you make the functionality of the program or a modified version available to third parties as a service
elastic-2.0: you may not provide the software to third parties as a hosted or managed service
busl-1.1: the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
openrail: you agree not to use the model or derivatives of the model in any way that violates
llama: grants you a? non exclusive worldwide non transferable and royalty free limited license under meta s intellectual property
"""

#: Machine-readable tags and addresses.
TAG = """
apache-2.0: spdx license identifier apache 2 0
apache-1.1: spdx license identifier apache 1 1
mit-0: spdx license identifier mit 0
mit: spdx license identifier mit
x11: spdx license identifier x11
isc: spdx license identifier isc
0bsd: spdx license identifier 0bsd
bsd-2-clause: spdx license identifier bsd 2 clause
bsd-3-clause: spdx license identifier bsd 3 clause
bsd-4-clause: spdx license identifier bsd 4 clause
gpl-2.0-only: spdx license identifier gpl 2 0 only
gpl-2.0-or-later: spdx license identifier gpl 2 0 or later
gpl-2.0: spdx license identifier gpl 2 0
gpl-3.0-only: spdx license identifier gpl 3 0 only
gpl-3.0-or-later: spdx license identifier gpl 3 0 or later
gpl-3.0: spdx license identifier gpl 3 0
lgpl-2.1-only: spdx license identifier lgpl 2 1 only
lgpl-2.1-or-later: spdx license identifier lgpl 2 1 or later
lgpl-2.1: spdx license identifier lgpl 2 1
lgpl-3.0-only: spdx license identifier lgpl 3 0 only
lgpl-3.0-or-later: spdx license identifier lgpl 3 0 or later
lgpl-3.0: spdx license identifier lgpl 3 0
agpl-3.0-only: spdx license identifier agpl 3 0 only
agpl-3.0-or-later: spdx license identifier agpl 3 0 or later
agpl-3.0: spdx license identifier agpl 3 0
mpl-2.0: spdx license identifier mpl 2 0
mpl-1.1: spdx license identifier mpl 1 1
epl-1.0: spdx license identifier epl 1 0
epl-2.0: spdx license identifier epl 2 0
cddl-1.0: spdx license identifier cddl 1 0
unlicense: spdx license identifier unlicense
zlib: spdx license identifier zlib
bsl-1.0: spdx license identifier bsl 1 0
busl-1.1: spdx license identifier busl 1 1
wtfpl: spdx license identifier wtfpl
cc0-1.0: spdx license identifier cc0 1 0
cc-by-4.0: spdx license identifier cc by 4 0
cc-by-sa-4.0: spdx license identifier cc by sa 4 0
cc-by-nc-4.0: spdx license identifier cc by nc 4 0
ofl-1.1: spdx license identifier ofl 1 1
postgresql: spdx license identifier postgresql
artistic-2.0: spdx license identifier artistic 2 0
eupl-1.2: spdx license identifier eupl 1 2
python-2.0: spdx license identifier python 2 0
apache-2.0: apache org licenses license 2 0
apache-2.0: opensource org licenses? apache 2 0
mit: opensource org licenses? mit
bsd-3-clause: opensource org licenses? bsd 3 clause
bsd-2-clause: opensource org licenses? bsd 2 clause
isc: opensource org licenses? isc
mpl-2.0: mozilla org mpl 2 0
mpl-2.0: mozilla org en us mpl 2 0
mpl-1.1: mozilla org mpl mpl 1 1
gpl: gnu org licenses gpl
gpl-2.0: gnu org licenses old licenses gpl 2 0
gpl-3.0: gnu org licenses gpl 3 0
lgpl: gnu org licenses lgpl
lgpl-3.0: gnu org licenses lgpl 3 0
lgpl-2.1: gnu org licenses old licenses lgpl 2 1
agpl: gnu org licenses agpl
agpl-3.0: gnu org licenses agpl 3 0
gfdl: gnu org licenses fdl
cc-by-nc-nd: creativecommons org licenses by nc nd
cc-by-nc-sa: creativecommons org licenses by nc sa
cc-by-nc: creativecommons org licenses by nc
cc-by-nd: creativecommons org licenses by nd
cc-by-sa: creativecommons org licenses by sa
cc-by: creativecommons org licenses by
cc0-1.0: creativecommons org publicdomain zero 1 0
public-domain: creativecommons org publicdomain mark 1 0
epl: eclipse org legal epl
unlicense: unlicense org
wtfpl: wtfpl net
zlib: zlib net zlib license
bsl-1.0: boost org license 1 0
ofl-1.1: scripts sil org ofl
"""

#: Names with a version.
VERSIONED = """
agpl-3.0-or-later: gnu affero general public license version/v 3 0? or any? later
agpl-3.0: gnu affero general public license version/v/v3? 3? 0?
agpl-3.0: agpl version/v? 3 0?
agpl-3.0: agplv3
lgpl-2.0: gnu library general public license version/v? 2
lgpl-2.1-or-later: gnu lesser general public license version/v? 2 1 or any? later
lgpl-2.1: gnu lesser general public license version/v? 2 1
lgpl-3.0-or-later: gnu lesser general public license version/v? 3 0? or any? later
lgpl-3.0: gnu lesser general public license version/v? 3 0?
lgpl-2.1: lgpl version/v? 2 1
lgpl-2.1: lgplv2 1
lgpl-3.0: lgpl version/v? 3 0?
lgpl-3.0: lgplv3
gpl-1.0: gnu general public license version/v? 1
gpl-2.0-or-later: gnu general public license version/v? 2 0? or any? later
gpl-2.0: gnu general public license version/v? 2 0?
gpl-2.0: gnu general public license v2
gpl-3.0-or-later: gnu general public license version/v? 3 0? or any? later
gpl-3.0: gnu general public license version/v? 3 0?
gpl-3.0: gnu general public license v3
gpl-2.0: gnu gpl version/v? 2
gpl-3.0: gnu gpl version/v? 3
gpl-2.0: gpl version/v? 2 0?
gpl-2.0: gplv2
gpl-3.0: gpl version/v? 3 0?
gpl-3.0: gplv3
gpl-2.0-with-classpath-exception: gpl version/v? 2 0? with the? classpath exception
gfdl-1.1: gnu free documentation license version/v? 1 1
gfdl-1.2: gnu free documentation license version/v? 1 2
gfdl-1.3: gnu free documentation license version/v? 1 3
apache-1.0: apache software? license version/v? 1 0
apache-1.1: apache software? license version/v? 1 1
apache-2.0: apache software? license version/v? 2 0?
apache-2.0: apache license v2 0?
apache-2.0: apache 2 0
apache-2.0: asl 2 0
mpl-1.0: mozilla public license version/v? 1 0
mpl-1.1: mozilla public license version/v? 1 1
mpl-2.0: mozilla public license version/v? 2 0
mpl-1.1: mpl version/v? 1 1
mpl-2.0: mpl version/v? 2 0
epl-1.0: eclipse public license version/v? 1 0
epl-2.0: eclipse public license version/v? 2 0
epl-2.0: epl version/v? 2 0
epl-1.0: epl version/v? 1 0
cddl-1.0: common development and distribution license cddl? version/v? 1 0
cddl-1.1: common development and distribution license cddl? version/v? 1 1
cddl-1.0: cddl version/v? 1 0
cddl-1.1: cddl version/v? 1 1
cpl-1.0: common public license version/v? 1 0
bsl-1.0: boost software license version/v? 1 0
busl-1.1: business source license version/v? 1 1
sspl-1.0: server side public license version/v? 1
elastic-2.0: elastic license version/v? 2 0?
artistic-1.0: artistic license version/v? 1 0
artistic-2.0: artistic license version/v? 2 0
afl-2.1: academic free license version/v? 2 1
afl-3.0: academic free license version/v? 3 0
osl-3.0: open software license version/v? 3 0
ofl-1.0: open font license version/v? 1 0
ofl-1.1: open font license version/v? 1 1
eupl-1.1: european union public licen[cs]e version/v? 1 1
eupl-1.2: european union public licen[cs]e version/v? 1 2
php-3.0: php license version/v? 3 0
php-3.01: php license version/v? 3 01
lppl-1.3c: latex project public license version/v? 1 3c
python-2.0: python software foundation license version/v? 2
openrail-m: bigscience openrail m
openrail-m: creativeml open rail m
openrail-m: openrail m
llama-2: llama 2 community license
llama-3: llama 3 community license
llama-3.1: llama 3 1 community license
cc0-1.0: cc0 version/v? 1 0
cc-by-nc-nd-2.0: cc by nc nd 2 0
cc-by-nc-nd-3.0: cc by nc nd 3 0
cc-by-nc-nd-4.0: cc by nc nd 4 0
cc-by-nc-sa-2.0: cc by nc sa 2 0
cc-by-nc-sa-2.5: cc by nc sa 2 5
cc-by-nc-sa-3.0: cc by nc sa 3 0
cc-by-nc-sa-4.0: cc by nc sa 4 0
cc-by-nc-2.0: cc by nc 2 0
cc-by-nc-2.5: cc by nc 2 5
cc-by-nc-3.0: cc by nc 3 0
cc-by-nc-4.0: cc by nc 4 0
cc-by-nd-2.0: cc by nd 2 0
cc-by-nd-3.0: cc by nd 3 0
cc-by-nd-4.0: cc by nd 4 0
cc-by-sa-2.0: cc by sa 2 0
cc-by-sa-2.5: cc by sa 2 5
cc-by-sa-3.0: cc by sa 3 0
cc-by-sa-4.0: cc by sa 4 0
cc-by-1.0: cc by 1 0
cc-by-2.0: cc by 2 0
cc-by-2.5: cc by 2 5
cc-by-3.0: cc by 3 0
cc-by-4.0: cc by 4 0
cc-by-nc-nd-4.0: creative commons attribution noncommercial/non commercial? no/noderivatives derivatives/derivs? 4 0
cc-by-nc-sa-4.0: creative commons attribution noncommercial/non commercial? share/sharealike alike? 4 0
cc-by-nc-4.0: creative commons attribution noncommercial/non commercial? 4 0
cc-by-sa-4.0: creative commons attribution share/sharealike alike? 4 0
cc-by-sa-3.0: creative commons attribution share/sharealike alike? 3 0
cc-by-nd-4.0: creative commons attribution no/noderivatives derivatives/derivs? 4 0
cc-by-4.0: creative commons attribution 4 0
cc-by-3.0: creative commons attribution 3 0
odbl-1.0: open database license version/v? 1 0
odc-by-1.0: open data commons attribution license version/v? 1 0
cdla-permissive-2.0: cdla permissive 2 0
cdla-permissive-1.0: cdla permissive 1 0
cdla-sharing-1.0: cdla sharing 1 0
"""

#: Names without a version.  The four base phrases stand among them.
TITLE = """
gpl: gnu general public license
apache: apache license
cc-by: cc by
mit: mit license
agpl: gnu affero general public license
agpl: affero general public license
lgpl: gnu lesser general public license
lgpl: gnu library general public license
gpl: general public license
gfdl: gnu free documentation license
apache: apache software license
mit-0: mit no attribution
mit: mit licensed
mit: expat license
mit: x11 mit license
x11: x11 license
isc: isc license
isc: internet systems consortium license
bsd-2-clause: bsd 2 clause
bsd-2-clause: 2 clause bsd
bsd-2-clause: simplified bsd license
bsd-2-clause: freebsd license
bsd-3-clause: bsd 3 clause
bsd-3-clause: 3 clause bsd
bsd-3-clause: new/modified/revised bsd license
bsd-4-clause: bsd 4 clause
bsd-4-clause: 4 clause bsd
bsd-4-clause: original bsd license
bsd: bsd license
bsd: bsd licensed
bsd: bsd style license
0bsd: zero clause bsd
0bsd: 0bsd license
mpl: mozilla public license
npl: netscape public license
epl: eclipse public license
cddl: common development and distribution license
cpl: common public license
bsl-1.0: boost software license
busl: business source license
sspl: server side public license
elastic: elastic license
artistic: artistic license
afl: academic free license
osl: open software license
ofl: open font license
eupl: european union public licen[cs]e
php: php license
python: python software foundation license
python: psf license
ruby: ruby license
perl: perl license
lppl: latex project public license
zlib: zlib license
zlib: zlib libpng license
libpng: libpng license
openssl: openssl license
postgresql: postgresql license
ncsa: university of illinois ncsa open source license
unlicense: the unlicense
wtfpl: do what the fuck you want to public license
beerware: beer ware license
json: json license
vim: vim license
ms-pl: microsoft public license
ms-rl: microsoft reciprocal license
ms-eula: microsoft software license terms
ibm: ibm public license
sun: sun public license
w3c: w3c software license
w3c: w3c software notice and license
unicode: unicode license agreement
oracle-bcl: oracle binary code license
oracle-otn: oracle technology network license
ecl: educational community license
cecill: cecill license
mulan: mulan permissive software license
hippocratic: hippocratic license
commons-clause: commons clause license condition
polyform: polyform noncommercial license
polyform: polyform small business license
cc0: creative commons zero
cc0: cc0 public domain dedication
cc-by-nc-nd: cc by nc nd
cc-by-nc-sa: cc by nc sa
cc-by-nc: cc by nc
cc-by-nd: cc by nd
cc-by-sa: cc by sa
cc-by-nc-nd: creative commons attribution noncommercial/non commercial? no/noderivatives derivatives/derivs?
cc-by-nc-sa: creative commons attribution noncommercial/non commercial? share/sharealike alike?
cc-by-nc: creative commons attribution noncommercial/non commercial?
cc-by-sa: creative commons attribution share/sharealike alike?
cc-by-nd: creative commons attribution no/noderivatives derivatives/derivs?
cc-by: creative commons attribution
odbl: open database license
odc-by: open data commons attribution license
pddl: public domain dedication and license
cdla: community data license agreement
public-domain: dedicated to the public domain
public-domain: released into the public domain
public-domain: in the public domain
"""

#: Short names and hints.
HINT = """
gpl: gnu gpl
lgpl: gnu lgpl
agpl: gnu agpl
gpl: gpl license/licensed
lgpl: lgpl license/licensed
agpl: agpl license/licensed
gpl: under the gpl
lgpl: under the lgpl
agpl: under the agpl
mpl: under the mpl
epl: under the epl
cddl: under the cddl
mit: under the? mit
apache: under the? apache
bsd: under the? bsd
isc: under the? isc
cc0: under the? cc0
wtfpl: wtfpl
unlicense: unlicense
cc: creative commons
cc0: cc0
proprietary: all rights reserved
proprietary: proprietary and confidential
proprietary: may not be reproduced without permission
proprietary: unauthorized copying of this file
proprietary: no part of this * may be reproduced
license-file: see the? license file
license-file: see license for details
"""

SECTIONS = [(5, 1.0, NOTICE), (4, 0.95, TAG), (3, 0.9, VERSIONED), (2, 0.75, TITLE), (1, 0.5, HINT)]
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Words too frequent in license lines, or in any text, to gate a rule.
FREQUENT = frozenset(
    "a all an and any are as at be by can copy do for free from general if in including into is it its license licensed licenses may no not of on or org other public "
    "purpose rights see software subject that the this to under use version v with without work you your".split())
