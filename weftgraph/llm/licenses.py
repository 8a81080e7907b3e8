"""License scan by ordered signature rules.

A rule is a regular expression with a priority and literal keywords, one of which any match must
hold, in lower case and with single spaces. A space of a rule stands for any white space, and after a line break for the marks
that start a comment's line as well, so that wrapped headers are found. An Aho-Corasick pass over each text so normalised finds the
keywords that occur; only their rules run. Gaps are possessive, and a version number ends where its digits end. Of the detections, taken by priority, then length, then place,
one is dropped when its interval lies within that of a detection already kept.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, tidy

#: Priorities: an explicit tag, sentences of a license's own text, a grant, an address, a bare name, a generic remark.
TAG, BODY, GRANT, ADDRESS, NAME, REMARK = 100, 90, 80, 70, 50, 10

# SPDX id | keywords of its name, separated by ; | the name as a regular expression (white space stands for any white space)
_NAMES = r"""
0BSD | clause bsd | (?:zero[- ]clause|0-clause) BSD(?: licen[cs]e)?
AFL-3.0 | academic free | Academic Free Licen[cs]e(?:,? (?:version |v\.? ?)?3(?:\.0)?)?
AGPL-1.0-only | affero | Affero General Public Licen[cs]e,? (?:version |v\.? ?)1(?:\.0)?
AGPL-3.0-only | affero | (?:GNU )?Affero (?:GNU )?General Public Licen[cs]e(?:,? (?:version |v\.? ?)3(?:\.0)?)?(?! or later)
AGPL-3.0-or-later | affero | (?:GNU )?Affero General Public Licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later(?: version)?
APSL-2.0 | apple public source | Apple Public Source Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
Apache-1.0 | apache licen;apache software | Apache (?:Software )?Licen[cs]e,? (?:version |v\.? ?)?1\.0
Apache-1.1 | apache licen;apache software | Apache (?:Software )?Licen[cs]e,? (?:version |v\.? ?)?1\.1
Apache-2.0 | apache licen;apache software | Apache (?:Software )?Licen[cs]e,? ?(?:version |v\.? ?|\(?v)?2(?:\.0)?\)?
Artistic-1.0 | artistic | Artistic Licen[cs]e,? (?:version |v\.? ?)?1(?:\.0)?
Artistic-2.0 | artistic | Artistic Licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
BSD-1-Clause | clause bsd | (?:1|one)[- ]clause BSD(?: licen[cs]e)?
BSD-2-Clause | clause bsd;simplified bsd;freebsd;bsd 2;bsd two | (?:(?:2|two)[- ]clause BSD|simplified BSD|FreeBSD|BSD (?:2|two)[- ]clause)(?: licen[cs]e)?
BSD-3-Clause | clause bsd;new bsd;revised bsd;modified bsd;bsd 3;bsd three | (?:(?:3|three)[- ]clause BSD|(?:new|revised|modified) BSD|BSD (?:3|three)[- ]clause)(?: licen[cs]e)?
BSD-4-Clause | clause bsd;original bsd;bsd 4;bsd four | (?:(?:4|four)[- ]clause BSD|original BSD|BSD (?:4|four)[- ]clause)(?: licen[cs]e)?
BSL-1.0 | boost | Boost Software Licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
BUSL-1.1 | business source | Business Source Licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?
Beerware | beerware;beer-ware | Beer-?ware Licen[cs]e
BlueOak-1.0.0 | blue oak | Blue Oak Model Licen[cs]e(?: 1\.0\.0)?
CC-BY-1.0 | cc by;cc-by | CC[- ]BY[- ]1\.0
CC-BY-2.0 | cc by;cc-by | CC[- ]BY[- ]2\.0
CC-BY-2.5 | cc by;cc-by | CC[- ]BY[- ]2\.5
CC-BY-3.0 | cc by;cc-by;creative commons | (?:CC[- ]BY[- ]3\.0|Creative Commons Attribution(?: 3\.0)(?: \w+)? Licen[cs]e)
CC-BY-4.0 | cc by;cc-by | CC[- ]BY[- ]4\.0
CC-BY-4.0-name | creative commons | Creative Commons Attribution 4\.0(?: International)?
CC-BY-NC-2.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]2\.0
CC-BY-NC-3.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]3\.0
CC-BY-NC-4.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]4\.0
CC-BY-NC-4.0-name | creative commons | Creative Commons Attribution[- ]Non-?Commercial 4\.0(?: International)?
CC-BY-NC-ND-3.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]ND[- ]3\.0
CC-BY-NC-ND-4.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]ND[- ]4\.0
CC-BY-NC-ND-4.0-name | creative commons | Creative Commons Attribution[- ]Non-?Commercial[- ]No ?Derivatives 4\.0(?: International)?
CC-BY-NC-SA-3.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]SA[- ]3\.0
CC-BY-NC-SA-4.0 | cc by;cc-by | CC[- ]BY[- ]NC[- ]SA[- ]4\.0
CC-BY-NC-SA-4.0-name | creative commons | Creative Commons Attribution[- ]Non-?Commercial[- ]Share ?Alike 4\.0(?: International)?
CC-BY-ND-3.0 | cc by;cc-by | CC[- ]BY[- ]ND[- ]3\.0
CC-BY-ND-4.0 | cc by;cc-by | CC[- ]BY[- ]ND[- ]4\.0
CC-BY-ND-4.0-name | creative commons | Creative Commons Attribution[- ]No ?Derivatives 4\.0(?: International)?
CC-BY-SA-2.0 | cc by;cc-by | CC[- ]BY[- ]SA[- ]2\.0
CC-BY-SA-2.5 | cc by;cc-by | CC[- ]BY[- ]SA[- ]2\.5
CC-BY-SA-3.0 | cc by;cc-by | CC[- ]BY[- ]SA[- ]3\.0
CC-BY-SA-4.0 | cc by;cc-by | CC[- ]BY[- ]SA[- ]4\.0
CC-BY-SA-4.0-name | creative commons | Creative Commons Attribution[- ]Share ?Alike 4\.0(?: International)?
CC0-1.0 | cc0 | \bCC0(?:[- ]1\.0)?(?: Universal)?
CDDL-1.0 | common development | Common Development and Distribution Licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
CDDL-1.1 | common development | Common Development and Distribution Licen[cs]e,? (?:version |v\.? ?)?1\.1
CECILL-2.1 | cecill | CeCILL(?:[- ](?:v|version )?2\.1)?(?: licen[cs]e)?
CPAL-1.0 | common public attribution | Common Public Attribution Licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
CPL-1.0 | common public | Common Public Licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
ECL-2.0 | educational community | Educational Community Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
EPL-1.0 | eclipse | Eclipse Public Licen[cs]e(?:,? ?-? ?(?:version |v\.? ?)?1(?:\.0)?)?
EPL-2.0 | eclipse | Eclipse Public Licen[cs]e,? ?-? ?(?:version |v\.? ?)?2(?:\.0)?
EUPL-1.1 | european union public | European Union Public Licen[cs]e,? (?:version |v\.? ?)?1\.1
EUPL-1.2 | european union public | European Union Public Licen[cs]e(?:,? (?:version |v\.? ?)?1\.2)?
Elastic-2.0 | elastic licen | Elastic Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
FSL-1.1 | functional source | Functional Source Licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?
FTL | freetype | FreeType (?:Project )?Licen[cs]e
GFDL-1.1 | free documentation | GNU Free Documentation Licen[cs]e,? (?:version |v\.? ?)?1\.1
GFDL-1.2 | free documentation | GNU Free Documentation Licen[cs]e,? (?:version |v\.? ?)?1\.2
GFDL-1.3 | free documentation | GNU Free Documentation Licen[cs]e(?:,? (?:version |v\.? ?)?1\.3)?
GPL-1.0-only | gnu general public;gnu gpl | GNU (?:General Public Licen[cs]e|GPL),? (?:version |v\.? ?)1(?:\.0)?
GPL-2.0-only | general public | GNU General Public Licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?
GPL-2.0-or-later | general public | GNU General Public Licen[cs]e,? (?:version |v\.? ?)?2(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later(?: version)?
GPL-2.0-short | gpl | \bGPL[- ]?(?:version |v\.? ?)?2(?:\.0)?\b
GPL-3.0-only | general public | GNU General Public Licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?
GPL-3.0-or-later | general public | GNU General Public Licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later(?: version)?
GPL-3.0-short | gpl | \bGPL[- ]?(?:version |v\.? ?)?3(?:\.0)?\b
HPND | historical permission | Historical Permission Notice and Disclaimer
ICU | icu licen | ICU Licen[cs]e
IPL-1.0 | ibm public | IBM Public Licen[cs]e(?:,? (?:version |v\.? ?)?1(?:\.0)?)?
ISC | isc licen | ISC Licen[cs]e
IJG | independent jpeg | Independent JPEG Group(?:'s)? Licen[cs]e
LGPL-2.0-only | library general public | GNU Library General Public Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
LGPL-2.1-only | lesser general public | GNU Lesser General Public Licen[cs]e,? (?:version |v\.? ?)?2\.1
LGPL-2.1-or-later | lesser general public | GNU Lesser General Public Licen[cs]e,? (?:version |v\.? ?)?2\.1,? or (?:\(at your option\) )?(?:any )?later(?: version)?
LGPL-3.0-only | lesser general public | GNU Lesser General Public Licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?
LGPL-3.0-or-later | lesser general public | GNU Lesser General Public Licen[cs]e,? (?:version |v\.? ?)?3(?:\.0)?,? or (?:\(at your option\) )?(?:any )?later(?: version)?
LPPL-1.3c | latex project | LaTeX Project Public Licen[cs]e(?:,? (?:version |v\.? ?)?1\.3c?)?
MIT | mit licen;mit/expat licen | \bMIT(?:/Expat)? Licen[cs]e
MIT-0 | mit no;mit-no;mit 0;mit-0 | MIT[- ](?:No Attribution|0)(?: licen[cs]e)?
MIT-Expat | expat licen | \bExpat Licen[cs]e
MPL-1.0 | mozilla | Mozilla Public Licen[cs]e,? (?:version |v\.? ?)?1\.0
MPL-1.1 | mozilla | Mozilla Public Licen[cs]e,? (?:version |v\.? ?)?1\.1
MPL-2.0 | mozilla | Mozilla Public Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
MS-PL | microsoft public | Microsoft Public Licen[cs]e
MS-RL | microsoft reciprocal | Microsoft Reciprocal Licen[cs]e
MulanPSL-2.0 | mulan | Mulan (?:PSL|Permissive Software Licen[cs]e)(?:,? ?(?:version |v\.? ?)?2)?
NCSA | ncsa licen;ncsa open | (?:University of Illinois/)?NCSA (?:Open Source )?Licen[cs]e
NPL-1.1 | netscape | Netscape Public Licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?
ODbL-1.0 | open database | Open (?:Data Commons )?(?:Open )?Database Licen[cs]e
ODC-By-1.0 | open data commons | Open Data Commons Attribution Licen[cs]e
OFL-1.1 | open font | (?:SIL )?Open Font Licen[cs]e(?:,? (?:version |v\.? ?)?1\.1)?
OpenSSL | openssl licen | OpenSSL Licen[cs]e
OSL-3.0 | open software | Open Software Licen[cs]e(?:,? (?:version |v\.? ?)?3(?:\.0)?)?
PDDL-1.0 | public domain dedication | (?:Open Data Commons )?Public Domain Dedication and Licen[cs]e
PHP-3.01 | php licen | PHP Licen[cs]e(?:,? (?:version |v\.? ?)?3\.01)?
PolyForm-NC-1.0.0 | polyform | PolyForm Noncommercial Licen[cs]e(?: 1\.0\.0)?
PostgreSQL | postgresql | PostgreSQL Licen[cs]e
PSF-2.0 | python software | Python Software Foundation Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
QPL-1.0 | q public | Q Public Licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
RPL-1.5 | reciprocal public | Reciprocal Public Licen[cs]e(?:,? (?:version |v\.? ?)?1\.5)?
Ruby | ruby licen | Ruby Licen[cs]e
SSPL-1.0 | server side public | Server Side Public Licen[cs]e(?:,? (?:version |v\.? ?)?1)?
SISSL | sun industry | Sun Industry Standards Source Licen[cs]e
Sleepycat | sleepycat | Sleepycat Licen[cs]e
UPL-1.0 | universal permissive | Universal Permissive Licen[cs]e(?:,? (?:version |v\.? ?)?1\.0)?
Unicode-DFS | unicode, inc;unicode inc | Unicode,? Inc\.? Licen[cs]e Agreement
Unlicense | unlicen | \bThe Unlicen[cs]e\b
Vim | vim licen | Vim Licen[cs]e
W3C | w3c software | W3C Software (?:Notice and )?Licen[cs]e
WTFPL | wtfpl | \bWTFPL\b
WTFPL-name | do what the f | Do What The F\w+ You Want To Public Licen[cs]e
X11 | x11 licen | \bX11 Licen[cs]e
Zend-2.0 | zend licen;zend engine | Zend (?:Engine )?Licen[cs]e(?:,? (?:version |v\.? ?)?2(?:\.0)?)?
Zlib | zlib licen;zlib/libpng | zlib(?:/libpng)? Licen[cs]e
ZPL-2.1 | zope | Zope Public Licen[cs]e(?:,? (?:version |v\.? ?)?2\.1)?
"""

# SPDX id | priority | keywords | regular expression
_TEXTS = r"""
MIT | 90 | permission is hereby granted | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
MIT | 90 | without restriction | to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge
MIT | 90 | the above copyright notice | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software
MIT | 85 | fitness for a particular | THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NON-?INFRINGEMENT
ISC | 90 | permission to use | Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted
Apache-2.0 | 90 | you may not use this file | you may not use this file except in compliance with the Licen[cs]e
Apache-2.0 | 90 | unless required by | Unless required by applicable law or agreed to in writing, software distributed under the Licen[cs]e is distributed on an "AS IS" BASIS
Apache-2.0 | 90 | terms and conditions for | TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
Apache-2.0 | 90 | contributor hereby grants | each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (?:copyright|\(except as stated in this section\) patent) licen[cs]e
BSD-2-Clause | 88 | redistribution and use | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
BSD-3-Clause | 91 | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
BSD-4-Clause | 92 | advertising materials | All advertising materials mentioning features or use of this software must display the following acknowledge?ment
BSD | 60 | redistributions of source | Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer
BSD | 60 | redistributions in binary | Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
GPL | 60 | free software | This program is free software[:;] you can redistribute it and/or modify it under the terms of the GNU General Public Licen[cs]e as published by the Free Software Foundation
GPL-2.0-or-later | 90 | version 2 of the licen | either version 2 of the Licen[cs]e, or \(?at your option\)? any later version
GPL-3.0-or-later | 90 | version 3 of the licen | either version 3 of the Licen[cs]e, or \(?at your option\)? any later version
LGPL-2.1-or-later | 90 | version 2.1 of the licen | either version 2\.1 of the Licen[cs]e, or \(?at your option\)? any later version
GPL | 60 | along with this program | You should have received a copy of the GNU General Public Licen[cs]e along with this program
LGPL | 60 | gnu lesser general | You should have received a copy of the GNU Lesser General Public Licen[cs]e along with this (?:library|program)
AGPL-3.0 | 90 | remote network interaction | Remote Network Interaction; Use with the GNU General Public Licen[cs]e
GPL-3.0-only | 90 | free, copyleft | The GNU General Public Licen[cs]e is a free, copyleft licen[cs]e for software and other kinds of works
GPL-2.0-only | 90 | share and change free | is intended to guarantee your freedom to share and change free software
MPL-2.0 | 90 | source code form is subject | This Source Code Form is subject to the terms of the Mozilla Public Licen[cs]e, v\. 2\.0
MPL-1.1 | 90 | contents of this file are subject | The contents of this file are subject to the Mozilla Public Licen[cs]e Version 1\.1
EPL-1.0 | 90 | this program and the accompanying | This program and the accompanying materials are made available under the terms of the Eclipse Public Licen[cs]e v1\.0
EPL-2.0 | 90 | this program and the accompanying | This program and the accompanying materials are made available under the terms of the Eclipse Public Licen[cs]e,? (?:v\.? ?)?2\.0
BSL-1.0 | 90 | any person or organization | Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this licen[cs]e
Zlib | 90 | the origin of this software | The origin of this software must not be misrepresented; you must not claim that you wrote the original software
Zlib | 90 | in no event will the authors | In no event will the authors be held liable for any damages arising from the use of this software
Unlicense | 90 | public domain | This is free and unencumbered software released into the public domain
CC0-1.0 | 90 | waive all | waive all copyright and related or neighboring rights
CC0-1.0 | 85 | public domain | has dedicated the work to the public domain
WTFPL | 90 | you just do what | You just DO WHAT THE F\w+ YOU WANT TO
Beerware | 90 | buy me a beer | you can buy me a beer in return
OFL-1.1 | 90 | this font software | This Font Software is licen[cs]ed under the SIL Open Font Licen[cs]e
OFL-1.1 | 85 | reserved font name | with Reserved Font Name
CDDL-1.0 | 90 | common development | The contents of this file are subject to the terms of the Common Development and Distribution Licen[cs]e
Artistic-2.0 | 90 | everyone is permitted | Everyone is permitted to copy and distribute verbatim copies of this licen[cs]e document, but changing it is not allowed\. Preamble This licen[cs]e establishes the terms under which a given free software Package
PSF-2.0 | 90 | python software foundation | PYTHON SOFTWARE FOUNDATION LICEN[CS]E VERSION 2
PostgreSQL | 90 | postgresql | PostgreSQL is released under the PostgreSQL Licen[cs]e
NCSA | 90 | to deal with the software | to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge
UPL-1.0 | 90 | subject to the condition | Subject to the condition set forth below, permission is hereby granted to any person obtaining a copy of this software
SSPL-1.0 | 90 | service source code | the Service Source Code for the Program or modified version
BUSL-1.1 | 90 | additional use | Additional Use Grant
ODbL-1.0 | 90 | open database | made available under the Open Database Licen[cs]e
Public-Domain | 60 | public domain | (?:released|placed|dedicated)(?: in| into| to) the public domain
Public-Domain | 40 | public domain | (?:this|the) (?:work|file|code|software|text) is in the public domain
Proprietary | 60 | proprietary and;confidential and | (?:proprietary and confidential|confidential and proprietary)
Proprietary | 60 | unauthorized copying;unauthorized reproduction;unauthorized distribution | Unauthorized (?:copying|reproduction|distribution)[^.\n]{0,80} (?:is )?(?:strictly )?prohibited
Proprietary | 40 | all rights reserved | All rights reserved
Copyright | 20 | copyright | Copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)\d\d)*
Copyright | 15 | © | © ?(?:19|20)\d\d(?: ?[-–,] ?(?:19|20)\d\d)*
Apache-2.0 | 70 | apache.org/licenses | https?://(?:www\.)?apache\.org/licenses/LICENSE-2\.0(?:\.html|\.txt)?
MIT | 70 | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/mit(?:-license)?(?:\.php|\.html)?
BSD-2-Clause | 70 | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/BSD-2-Clause
BSD-3-Clause | 70 | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/BSD-3-Clause
ISC | 70 | opensource.org/licenses | https?://(?:www\.)?opensource\.org/licenses/ISC
GPL-2.0-only | 70 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.\w+)?
GPL-3.0-only | 70 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/gpl-3\.0(?:\.\w+)?
GPL | 65 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/gpl\.\w+
LGPL-2.1-only | 70 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1(?:\.\w+)?
LGPL-3.0-only | 70 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/lgpl-3\.0(?:\.\w+)?
AGPL-3.0-only | 70 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/agpl-3\.0(?:\.\w+)?
GFDL-1.3 | 70 | gnu.org/licenses | https?://(?:www\.)?gnu\.org/licenses/fdl-1\.3(?:\.\w+)?
MPL-1.1 | 70 | mozilla.org/mpl | https?://(?:www\.)?mozilla\.org/MPL/1\.1/?
MPL-2.0 | 70 | mozilla.org/ | https?://(?:www\.)?mozilla\.org/(?:en-US/)?MPL/2\.0/?
EPL-1.0 | 70 | eclipse.org/ | https?://(?:www\.)?eclipse\.org/(?:legal|org/documents)/epl-v10(?:\.html)?
EPL-2.0 | 70 | eclipse.org/ | https?://(?:www\.)?eclipse\.org/(?:legal/|org/documents/)epl-2\.0/?
BSL-1.0 | 70 | boost.org | https?://(?:www\.)?boost\.org/LICENSE_1_0\.txt
Unlicense | 70 | unlicense.org | https?://(?:www\.)?unlicense\.org/?
WTFPL | 70 | wtfpl.net | https?://(?:www\.)?wtfpl\.net(?:/about)?/?
OFL-1.1 | 70 | sil.org/ofl | https?://scripts\.sil\.org/OFL
CC0-1.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/publicdomain/zero/1\.0/?
CC-PDM-1.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/publicdomain/mark/1\.0/?
CC-BY-2.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by/2\.0/?
CC-BY-3.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by/3\.0/?
CC-BY-4.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by/4\.0/?
CC-BY-SA-3.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/3\.0/?
CC-BY-SA-4.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-sa/4\.0/?
CC-BY-NC-3.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/3\.0/?
CC-BY-NC-4.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc/4\.0/?
CC-BY-NC-SA-4.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-sa/4\.0/?
CC-BY-NC-ND-4.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nc-nd/4\.0/?
CC-BY-ND-4.0 | 70 | creativecommons.org | https?://(?:www\.)?creativecommons\.org/licenses/by-nd/4\.0/?
CC-generic | 30 | creative commons | Creative Commons(?: \w+){0,3} licen[cs]e
GPL | 30 | general public licen | GNU General Public Licen[cs]e
LGPL | 30 | lesser general public | (?:GNU )?Lesser General Public Licen[cs]e
AGPL | 30 | affero | Affero General Public Licen[cs]e
BSD | 30 | bsd licen;bsd-style;bsd style | \bBSD(?:[- ]style)? licen[cs]e
Apache | 30 | apache licen;apache software | \bApache(?: Software)? Licen[cs]e
GPL | 25 | gpl | \bGPL\b
LGPL | 25 | lgpl | \bLGPL\b
AGPL | 25 | agpl | \bAGPL\b
Apache-2.0 | 88 | derivative works a copy | You must give any other recipients of the Work or Derivative Works a copy of this Licen[cs]e
Apache-2.0 | 88 | prominent notices stating | You must cause any modified files to carry prominent notices stating that You changed the files
Apache-2.0 | 88 | names, trademarks, service marks | This Licen[cs]e does not grant permission to use the trade names, trademarks, service marks, or product names of the Licensor
Apache-1.1 | 90 | developed by the apache | This product includes software developed by the Apache (?:Software Foundation|Group)
Apache-1.1 | 90 | products derived from this software may not be called | Products derived from this software may not be called "?Apache"?
GPL-2.0-only | 88 | when we speak of free software | When we speak of free software, we are referring to freedom, not price\. Our General Public Licen[cs]es are designed to make sure that you have the freedom to distribute copies of free software \(and charge for this service if you wish\)
GPL-2.0-only | 88 | this license applies to any program;this licence applies to any program | This Licen[cs]e applies to any program or other work which contains a notice placed by the copyright holder
GPL-2.0-only | 88 | accompany it with the complete | Accompany it with the complete corresponding machine-readable source code
GPL-3.0-only | 88 | to protect your rights | To protect your rights, we need to prevent others from denying you these rights or asking you to surrender the rights
GPL-3.0-only | 88 | user product | A "?User Product"? is either \(1\) a "?consumer product"?
GPL-3.0-only | 88 | conveying verbatim | Conveying Verbatim Copies\.? You may convey verbatim copies of the Program's source code as you receive it
GPL-3.0-only | 88 | automatic licensing of downstream | Automatic Licensing of Downstream Recipients
LGPL-2.1-only | 90 | library (or with a work;work based on the library | A "?work based on the Library"? means either the Library or any derivative work
LGPL-2.1-only | 90 | designated software packages | This licen[cs]e, the Lesser General Public Licen[cs]e, applies to some specially designated software packages
LGPL-3.0-only | 90 | incorporates the terms and conditions of version 3 | This version of the GNU Lesser General Public Licen[cs]e incorporates the terms and conditions of version 3
LGPL-2.0-only | 90 | released version of the library gpl | the first released version of the library GPL
LGPL | 60 | this library is free software | This library is free software[:;] you can redistribute it and/or modify it under the terms of the GNU (?:Lesser|Library) General Public Licen[cs]e
AGPL-3.0 | 90 | interacting with it remotely | all users interacting with it remotely through a computer network
AGPL-3.0-or-later | 80 | affero general public | it under the terms of the GNU Affero General Public Licen[cs]e as published by the Free Software Foundation
GPL-exception | 70 | special exception | As a special exception,? (?:the copyright holders?|you may|if you|to the GNU)
MPL-2.0 | 90 | could not distribute;can obtain one at | If a copy of the MPL was not distributed with this file, You can obtain one at
MPL-2.0 | 88 | incompatible with secondary | "?Incompatible With Secondary Licen[cs]es"?
MPL-1.1 | 88 | software distributed under the license is distributed | Software distributed under the Licen[cs]e is distributed on an "AS IS" basis, WITHOUT WARRANTY OF ANY KIND, either express or implied\. See the Licen[cs]e for the specific language governing rights and limitations
MPL-1.1 | 88 | the initial developer of the | The Initial Developer of the Original Code is
EPL-2.0 | 88 | secondary license;secondary licence | This Source Code may also be made available under the following Secondary Licen[cs]es
EPL-1.0 | 85 | this eclipse public;eclipse public | THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICEN[CS]E
CPL-1.0 | 90 | common public | THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS COMMON PUBLIC LICEN[CS]E
CDDL-1.0 | 85 | cddl header | CDDL HEADER START
BSD-2-Clause-Views | 91 | official policies | should not be interpreted as representing official policies, either expressed or implied
BSD-3-Clause-Clear | 92 | no express or implied | NO EXPRESS OR IMPLIED LICEN[CS]ES TO ANY PARTY'S PATENT RIGHTS ARE GRANTED BY THIS LICEN[CS]E
BSD-3-Clause | 88 | neither the name | Neither the names? of (?:the )?[\w<>.,'"()\s-]{1,120}? nor the names of (?:its|his|her|their|any) contributors
BSD | 60 | software is provided by the | THIS SOFTWARE IS PROVIDED BY THE (?:COPYRIGHT HOLDERS(?: AND CONTRIBUTORS)?|REGENTS AND CONTRIBUTORS|AUTHORS?) "?AS IS"? AND ANY EXPRESS OR IMPLIED WARRANTIES
BSD | 55 | regents and contributors | THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS
BSD-4-Clause | 92 | university of california, berkeley | This product includes software developed by the University of California, Berkeley
0BSD | 92 | permission to use | Permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee is hereby granted\. THE SOFTWARE
ISC | 85 | the author disclaims | THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS
MIT-0 | 92 | to do so | to permit persons to whom the Software is furnished to do so\. THE SOFTWARE IS PROVIDED
X11 | 92 | x consortium | Except as contained in this notice, the name of the X Consortium shall not be used in advertising
X11 | 88 | except as contained in this notice | Except as contained in this notice, the names? of [\w<>.,'"()\s-]{1,120}? shall not be used in advertising or otherwise to promote the sale
MIT-feh | 85 | shall be given in the documentation | acknowledge?ment shall be given in the documentation
JSON | 95 | good, not evil | The Software shall be used for Good, not Evil
Commons-Clause | 95 | commons clause | "?Commons Clause"? Licen[cs]e Condition
HPND | 88 | appear in supporting documentation | that both that copyright notice and this permission notice appear in supporting documentation
NTP | 88 | representations about the suitability | makes no representations about the suitability (?:of )?this software for any purpose
SMLNJ | 88 | and its documentation for any purpose and without fee | Permission to use, copy, modify, and distribute this software and its documentation for any purpose and without fee is hereby granted
PostgreSQL | 91 | without a written agreement | for any purpose, without fee, and without a written agreement is hereby granted
TCL | 90 | this notice is included verbatim | provided that existing copyright notices are retained in all copies and that this notice is included verbatim in any distributions
Zlib | 88 | altered source versions | Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software
Zlib | 88 | may not be removed or altered | This notice may not be removed or altered from any source distribution
Libpng | 90 | supplied "as is";png reference | The PNG Reference Library is supplied "AS IS"
OpenSSL | 92 | openssl toolkit;openssl project | This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit
SSLeay | 92 | eric young | This product includes cryptographic software written by Eric Young
PHP-3.01 | 90 | includes php software | This product includes PHP software, freely available from
PSF-2.0 | 88 | psf is making python | PSF is making Python available to Licensee on an "AS IS" basis
PSF-2.0 | 85 | beopen.com | BEOPEN\.COM LICEN[CS]E AGREEMENT FOR PYTHON
CNRI-Python | 90 | cnri | CNRI (?:OPEN SOURCE )?LICEN[CS]E AGREEMENT
W3C | 90 | permission to copy, modify, and distribute | Permission to copy, modify, and distribute this software and its documentation, with or without modification, for any purpose and without fee or royalty is hereby granted
Unicode-3.0 | 90 | and any associated documentation | Permission is hereby granted, free of charge, to any person obtaining a copy of (?:the Unicode )?data files and any associated documentation
ICU | 88 | this permission notice appear in all copies | provided that the above copyright notice\(s\) and this permission notice appear in all copies of the Software
curl | 90 | copy, modify, and distribute this software for any purpose | All rights reserved\. Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies
IJG | 90 | independent jpeg | This software is based in part on the work of the Independent JPEG Group
FTL | 90 | freetype | Portions of this software are copyright (?:\(c\)|©)? ?[\w<>\s,-]{0,40} ?The FreeType Project
MS-PL | 90 | bring a patent claim | If you bring a patent claim against any contributor over patents that you claim are infringed by the software, your patent licen[cs]e from such contributor to the software ends automatically
MS-PL | 85 | this license governs use;this licence governs use | This licen[cs]e governs use of the accompanying software\. If you use the software, you accept this licen[cs]e
MS-RL | 92 | reciprocal grants | Reciprocal Grants ?[-–]? ?For any file you distribute that contains code from the software
Ruby | 88 | place your modifications | place your modifications in the Public Domain or otherwise make them Freely Available
Artistic-1.0 | 90 | state the conditions under which a package | The intent of this document is to state the conditions under which a Package may be copied
Artistic-2.0 | 88 | use the standard version | You are permitted to use the Standard Version and create and use Modified Versions for any purpose
Vim | 90 | charityware;help poor children | Vim is Charityware
LPPL-1.3c | 90 | conditions of the latex | This work may be distributed and/or modified under the conditions of the LaTeX Project Public Licen[cs]e
OFL-1.1 | 88 | sold by itself | Neither the Font Software nor any of its individual components,? in Original or Modified Versions,? may be sold by itself
UPL-1.0 | 88 | larger works | the "?Larger Works"?
NCSA | 88 | university of illinois | Developed by: ?[\w\s,.-]{0,80} University of Illinois
CC0-1.0 | 88 | affirmer | Affirmer hereby overtly, fully, permanently, irrevocably and unconditionally waives
CC-BY-4.0 | 88 | attribution 4.0 | Creative Commons Attribution 4\.0 International Public Licen[cs]e
CC-BY-SA-4.0 | 90 | sharealike 4.0 | Creative Commons Attribution-ShareAlike 4\.0 International Public Licen[cs]e
CC-BY-NC-4.0 | 90 | noncommercial 4.0 | Creative Commons Attribution-NonCommercial 4\.0 International Public Licen[cs]e
CC-BY-NC-SA-4.0 | 92 | noncommercial-sharealike | Creative Commons Attribution-NonCommercial-ShareAlike 4\.0 International Public Licen[cs]e
CC-BY-NC-ND-4.0 | 92 | noncommercial-noderivatives | Creative Commons Attribution-NonCommercial-NoDerivatives 4\.0 International Public Licen[cs]e
CC-BY-ND-4.0 | 90 | attribution-noderivatives | Creative Commons Attribution-NoDerivatives 4\.0 International Public Licen[cs]e
ODbL-1.0 | 88 | produced work | you must include a notice associated with the Produced Work
SSPL-1.0 | 92 | offering the program as a service | Offering the Program as a Service
Elastic-2.0 | 90 | hosted or managed service | You may not provide the software to third parties as a hosted or managed service
BUSL-1.1 | 88 | change date | on the Change Date, or the fourth anniversary of the first publicly available distribution
PolyForm-NC-1.0.0 | 90 | noncommercial purpose | Any noncommercial purpose is a permitted purpose
Hippocratic | 90 | hippocratic | Hippocratic Licen[cs]e(?: HL3| \d\.\d)?
OpenRAIL | 85 | openrail;open rail | (?:\w+ )?Open ?RAIL(?:-[MSDA])?(?: Licen[cs]e)?
Llama | 85 | llama | (?:META )?LLAMA \d(?:\.\d)? COMMUNITY LICEN[CS]E(?: AGREEMENT)?
SQLite-blessing | 90 | do good and not evil | May you do good and not evil
Sendmail | 85 | sendmail licen | SENDMAIL LICEN[CS]E
EUPL-1.2 | 88 | licensed under the eupl;licenced under the eupl | Licen[cs]ed under the EUPL
CECILL-2.1 | 88 | governed by the cecill | This software is governed by the CeCILL licen[cs]e
Proprietary | 55 | trade secret | (?:contains|constitutes?) (?:confidential|proprietary)(?: and proprietary)? (?:information|trade secrets?)
Proprietary | 55 | internal use only | for internal use only
Unknown | 10 | licensed under;licenced under | (?:is |are )?licen[cs]ed under(?: the)?(?: terms of)?
Unknown | 10 | see licen;see the licen;see copying;see the copying;see file;see the file;see accompanying;see the accompanying | See (?:the )?(?:accompanying )?(?:file )?(?:LICEN[CS]E|COPYING)(?:\.\w+)?(?: file)?
"""

_GRANT = (
    r"(?:(?:this|the) (?:work|file|code|software|program|text|document|project|content|package|library) (?:is|are) )?"
    r"(?:licen[cs]ed|(?:re)?released|(?:re)?distributed|published|made available|provided|offered|covered)(?: to you)?"
    r" (?:under|by|with)(?: the)?(?: terms(?: and conditions)? of(?: the)?)?(?: an?)? "
)


#: What may stand before the words on a comment's line.
_LEADERS = r"[\s#*/;%!|>-]*+"
_GAP = rf"[^\S\n]*+\n{_LEADERS}|\s++"
_WRAP = re.compile(rf"\n{_LEADERS}")


class Rule:
    """One signature: where it stands in the order, what it finds, and what must occur for it to match."""

    def __init__(self, number: int, license_id: str, priority: int, keyword: str, pattern: str) -> None:
        self.name, self.license, self.priority, self.keywords = f"r{number:03d}", license_id, priority, tuple(keyword.split(";"))
        for a, b in (("[- ]", r"[-\s]"), ("[ ]", r"\s"), (" ?", f"(?:{_GAP})?+"), (" ", f"(?:{_GAP})")):
            pattern = pattern.replace(a, b)
        self.regex = re.compile(f"(?:{pattern})(?:(?<!\\d)|(?!\\.?\\d))", re.I | re.A)


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, in order: for each named license its tag, its grants and its name; then texts and addresses."""
    made: list[tuple[str, int, str, str]] = []
    for line in _NAMES.strip().splitlines():
        spdx, keyword, name = (x.strip() for x in line.split("|", 2))
        plain = re.sub(r"-(?:name|short)$", "", spdx)
        if plain == spdx:
            tag = re.escape(re.sub(r"-(?:only|or-later)$", "", spdx)).replace(r"\ ", " ")
            suffix = {"only": r"(?:-only)?", "later": r"(?:-or-later|\+)"}.get(spdx.rsplit("-", 1)[-1], "")
            made.append((spdx, TAG, "spdx-licen", rf"SPDX-Licen[cs]e-Identifier:[ ]*\(?{tag}{suffix}(?![\w.+-])"))
        made.append((plain, GRANT, keyword, _GRANT + f"(?:{name})"))
        made.append((plain, NAME, keyword, name))
    for line in _TEXTS.strip().splitlines():
        spdx, priority, keyword, pattern = (x.strip() for x in line.split("|", 3))
        made.append((spdx, int(priority), keyword, pattern))
    return tuple(Rule(n, *m) for n, m in enumerate(made))


@lru_cache(maxsize=1)
def _automaton():
    at: dict[str, list[int]] = {}
    for n, r in enumerate(rules()):
        for k in r.keywords:
            at.setdefault(k, []).append(n)
    a = ahocorasick.Automaton()
    for word, numbers in at.items():
        a.add_word(word, (word, tuple(numbers)))
    a.make_automaton()
    return a


def candidates(text: str) -> list[int]:
    """Numbers of the rules whose keyword the text holds."""
    words = {w for _, w in _automaton().iter(" ".join(_WRAP.sub(" ", text.lower()).split()))}
    return sorted({n for _, numbers in words for n in numbers})


def resolve(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of (rule number, start, end), those that do not lie within a better one; by place."""
    book = rules()
    kept: list[tuple[int, int, int]] = []
    starts: list[int] = []  # of kept intervals that lie in no other one, so that the ends ascend as well
    ends: list[int] = []
    for n, a, b in sorted(found, key=lambda f: (-book[f[0]].priority, f[1] - f[2], f[1], f[0])):
        at = bisect_right(starts, a)
        if at and ends[at - 1] >= b:
            continue
        kept.append((n, a, b))
        at = bisect_left(starts, a)
        over = bisect_right(ends, b, lo=at)
        starts[at:over], ends[at:over] = [a], [b]
    return sorted(kept, key=lambda f: (f[1], f[2], f[0]))


def detect(text: str, numbers: list[int] | None = None) -> list[tuple[int, int, int]]:
    """All detections that stand, by rules ``numbers`` or those that the prefilter lets through."""
    book = rules()
    found = [(n, m.start(), m.end()) for n in (candidates(text) if numbers is None else numbers) for m in book[n].regex.finditer(text) if m.end() > m.start()]
    return resolve(found)


_OUT = "doc_id bigint, license string, rule string, priority int, start int, end int, matched string"


def scan(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row a detection: ``doc_id``, ``license``, ``rule``, ``priority``, ``start``, ``end``, ``matched``.

    ``start`` and ``end`` are code points. A text that is null, empty or without any detection has no row.
    Null ids and repeated rows are kept, each with its own detections. Ids are integers, or strings of integers; any other string is an error. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = rules()
        for b in batches:
            out = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                t = t.as_py()
                for n, a, e in detect(t) if t else ():
                    out.append((i, book[n].license, book[n].name, book[n].priority, a, e, t[a:e]))
            if out:
                kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "license", "rule", "priority", "start", "end", "matched"])

    docs = tidy(df).filter(col(text_col).isNotNull() & (F.length(col(text_col)) > 0))
    return docs.select(col(id_col).cast("bigint").alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, _OUT)
