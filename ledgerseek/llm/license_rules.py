"""Signature rules of the license scan, in order: ``label | priority | keyword | pattern``.

A blank in a pattern stands for any run of up to 12 characters that are neither ASCII
letters nor digits.  A rule is tried only on texts that contain its keyword.  Priorities:
90 license identifiers, 80 versioned names and addresses, 70 characteristic sentences,
60 unversioned names, 40 generic notices.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_TABLE = r"""
gpl-1.0-only | 90 | gpl-1 | spdx license identifier gpl 1\.0(?: only)?
gpl-2.0-only | 90 | gpl-2 | spdx license identifier gpl 2\.0(?: only)?
gpl-2.0-or-later | 91 | gpl-2 | spdx license identifier gpl 2\.0(?:\+| or later)
gpl-3.0-only | 90 | gpl-3 | spdx license identifier gpl 3\.0(?: only)?
gpl-3.0-or-later | 91 | gpl-3 | spdx license identifier gpl 3\.0(?:\+| or later)
lgpl-2.0-only | 90 | lgpl-2 | spdx license identifier lgpl 2\.0(?: only)?
lgpl-2.1-only | 90 | lgpl-2 | spdx license identifier lgpl 2\.1(?: only)?
lgpl-2.1-or-later | 91 | lgpl-2 | spdx license identifier lgpl 2\.1(?:\+| or later)
lgpl-3.0-only | 90 | lgpl-3 | spdx license identifier lgpl 3\.0(?: only)?
lgpl-3.0-or-later | 91 | lgpl-3 | spdx license identifier lgpl 3\.0(?:\+| or later)
agpl-3.0-only | 90 | agpl-3 | spdx license identifier agpl 3\.0(?: only)?
agpl-3.0-or-later | 91 | agpl-3 | spdx license identifier agpl 3\.0(?:\+| or later)
mit | 90 | spdx | spdx license identifier mit\b
mit-0 | 91 | mit-0 | spdx license identifier mit 0\b
apache-2.0 | 90 | apache-2 | spdx license identifier apache 2\.0
apache-1.1 | 90 | apache-1 | spdx license identifier apache 1\.1
bsd-2-clause | 90 | bsd-2 | spdx license identifier bsd 2 clause
bsd-3-clause | 90 | bsd-3 | spdx license identifier bsd 3 clause
bsd-4-clause | 90 | bsd-4 | spdx license identifier bsd 4 clause
0bsd | 90 | 0bsd | spdx license identifier 0bsd
isc | 90 | spdx | spdx license identifier isc\b
mpl-1.1 | 90 | mpl-1 | spdx license identifier mpl 1\.1
mpl-2.0 | 90 | mpl-2 | spdx license identifier mpl 2\.0
epl-1.0 | 90 | epl-1 | spdx license identifier epl 1\.0
epl-2.0 | 90 | epl-2 | spdx license identifier epl 2\.0
eupl-1.1 | 90 | eupl-1 | spdx license identifier eupl 1\.1
eupl-1.2 | 90 | eupl-1 | spdx license identifier eupl 1\.2
cddl-1.0 | 90 | cddl-1 | spdx license identifier cddl 1\.0
cddl-1.1 | 90 | cddl-1 | spdx license identifier cddl 1\.1
unlicense | 90 | spdx | spdx license identifier unlicense
wtfpl | 90 | spdx | spdx license identifier wtfpl
zlib | 90 | spdx | spdx license identifier zlib
bsl-1.0 | 90 | bsl-1 | spdx license identifier bsl 1\.0
busl-1.1 | 90 | busl-1 | spdx license identifier busl 1\.1
artistic-2.0 | 90 | artistic | spdx license identifier artistic 2\.0
cc0-1.0 | 90 | cc0 | spdx license identifier cc0 1\.0
cc-by-4.0 | 90 | cc-by | spdx license identifier cc by 4\.0
cc-by-sa-4.0 | 91 | cc-by | spdx license identifier cc by sa 4\.0
osl-3.0 | 90 | osl-3 | spdx license identifier osl 3\.0
afl-3.0 | 90 | afl-3 | spdx license identifier afl 3\.0
postgresql | 90 | spdx | spdx license identifier postgresql
python-2.0 | 90 | spdx | spdx license identifier (?:python|psf) 2\.0
ms-pl | 90 | ms-pl | spdx license identifier ms pl
ms-rl | 90 | ms-rl | spdx license identifier ms rl
sspl-1.0 | 90 | sspl | spdx license identifier sspl 1\.0
ncsa | 90 | spdx | spdx license identifier ncsa
upl-1.0 | 90 | upl-1 | spdx license identifier upl 1\.0
ofl-1.1 | 90 | ofl-1 | spdx license identifier ofl 1\.1
vim | 90 | spdx | spdx license identifier vim\b
blueoak-1.0.0 | 90 | blueoak | spdx license identifier blueoak 1\.0\.0
gpl-1.0-only | 80 | gnu gen | gnu general public license(?: as published by the free software foundation)?(?: either)?,? v(?:ersion|\.)? ?1\b
gpl-2.0-only | 80 | gnu gen | gnu general public license(?: \(?gpl\)?)?,? v(?:ersion|\.)? ?2(?:\.0)?\b
gpl-2.0-or-later | 82 | gnu gen | gnu general public license[^.]{0,90} either version 2 of the license or (?:\(at your option\) )?(?:at your option )?any later version
gpl-3.0-only | 80 | gnu gen | gnu general public license(?: \(?gpl\)?)?,? v(?:ersion|\.)? ?3(?:\.0)?\b
gpl-3.0-or-later | 82 | gnu gen | gnu general public license[^.]{0,90} either version 3 of the license or (?:at your option )?any later version
lgpl-2.0-only | 80 | gnu lib | gnu library general public license,? v(?:ersion|\.)? ?2(?:\.0)?\b
lgpl-2.1-only | 80 | gnu les | gnu lesser general public license,? v(?:ersion|\.)? ?2\.1\b
lgpl-2.1-or-later | 82 | gnu les | gnu lesser general public license[^.]{0,90} either version 2\.1 of the license or (?:at your option )?any later version
lgpl-3.0-only | 80 | gnu les | gnu lesser general public license,? v(?:ersion|\.)? ?3(?:\.0)?\b
lgpl-3.0-or-later | 82 | gnu les | gnu lesser general public license[^.]{0,90} either version 3 of the license or (?:at your option )?any later version
agpl-3.0-only | 80 | gnu aff | gnu affero general public license,? v(?:ersion|\.)? ?3(?:\.0)?\b
agpl-3.0-or-later | 82 | gnu aff | gnu affero general public license[^.]{0,90} either version 3 of the license or (?:at your option )?any later version
agpl-1.0 | 80 | affero | affero general public license,? version 1\b
gfdl-1.1 | 80 | gnu fre | gnu free documentation license,? version 1\.1\b
gfdl-1.2 | 80 | gnu fre | gnu free documentation license,? version 1\.2\b
gfdl-1.3 | 80 | gnu fre | gnu free documentation license,? version 1\.3\b
apache-1.0 | 80 | apache | apache (?:software )?license,? v(?:ersion|\.)? ?1\.0\b
apache-1.1 | 80 | apache | apache (?:software )?license,? v(?:ersion|\.)? ?1\.1\b
apache-2.0 | 80 | apache | apache (?:software )?license,? v(?:ersion|\.)? ?2(?:\.0)?\b
apache-2.0 | 80 | apache | (?:https?)? ?www apache org licenses license 2\.0
apache-2.0 | 80 | apache | apache org licenses license 2\.0
mpl-1.0 | 80 | mozilla | mozilla public license,? v(?:ersion|\.)? ?1\.0\b
mpl-1.1 | 80 | mozilla | mozilla public license,? v(?:ersion|\.)? ?1\.1\b
mpl-2.0 | 80 | mozilla | mozilla public license,? v(?:ersion|\.)? ?2\.0\b
mpl-2.0 | 80 | mozilla | mozilla org mpl 2\.0
epl-1.0 | 80 | eclipse | eclipse public license,? v(?:ersion|\.)? ?1\.0\b
epl-2.0 | 80 | eclipse | eclipse public license,? v(?:ersion|\.)? ?2\.0\b
epl-1.0 | 80 | eclipse | eclipse org legal epl v10
epl-2.0 | 80 | eclipse | eclipse org legal epl 2\.0
edl-1.0 | 80 | eclipse | eclipse distribution license,? v(?:ersion|\.)? ?1\.0
eupl-1.1 | 80 | european union public | european union public licen[cs]e,? v(?:ersion|\.)? ?1\.1
eupl-1.2 | 80 | european union public | european union public licen[cs]e,? v(?:ersion|\.)? ?1\.2
cddl-1.0 | 80 | common development | common development and distribution license \(?cddl\)?,? v(?:ersion|\.)? ?1\.0
cddl-1.1 | 80 | common development | common development and distribution license \(?cddl\)?,? v(?:ersion|\.)? ?1\.1
cpl-1.0 | 80 | common public | common public license,? v(?:ersion|\.)? ?1\.0
ipl-1.0 | 80 | ibm public | ibm public license,? v(?:ersion|\.)? ?1\.0
bsd-2-clause | 80 | bsd | (?:bsd 2 clause|2 clause bsd|simplified bsd|freebsd) license
bsd-3-clause | 80 | bsd | (?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd) license
bsd-4-clause | 80 | bsd | (?:bsd 4 clause|4 clause bsd|original bsd|old bsd) license
bsd-1-clause | 80 | bsd | (?:bsd 1 clause|1 clause bsd) license
0bsd | 80 | bsd | (?:zero clause bsd|bsd zero clause|0 clause bsd) license
bsd-3-clause-clear | 82 | clear bsd | clear bsd license
bsd-2-clause-patent | 82 | patent | bsd 2 clause plus patent license
bsd-3-clause-lbnl | 82 | lawrence | lawrence berkeley national labs bsd
boost-1.0 | 80 | boost | boost software license,? v(?:ersion|\.)? ?1\.0
boost-1.0 | 80 | boost | boost org license 1 0
artistic-1.0 | 80 | artistic | artistic license,? (?:v(?:ersion|\.)? ?)?1\.0
artistic-2.0 | 80 | artistic | artistic license,? (?:v(?:ersion|\.)? ?)?2\.0
afl-2.1 | 80 | academic | academic free license,? v(?:ersion|\.)? ?2\.1
afl-3.0 | 80 | academic | academic free license,? v(?:ersion|\.)? ?3\.0
osl-1.0 | 80 | open software | open software license,? v(?:ersion|\.)? ?1\.0
osl-2.1 | 80 | open software | open software license,? v(?:ersion|\.)? ?2\.1
osl-3.0 | 80 | open software | open software license,? v(?:ersion|\.)? ?3\.0
apsl-2.0 | 80 | apple public | apple public source license,? v(?:ersion|\.)? ?2\.0
qpl-1.0 | 80 | q public | q public license,? v(?:ersion|\.)? ?1\.0
lppl-1.3c | 80 | latex project | latex project public license,? v(?:ersion|\.)? ?1\.3c?
zpl-2.1 | 80 | zope | zope public license,? v(?:ersion|\.)? ?2\.1
zpl-2.0 | 80 | zope | zope public license,? v(?:ersion|\.)? ?2\.0
php-3.0 | 80 | php | php license,? v(?:ersion|\.)? ?3\.0\b
php-3.01 | 80 | php | php license,? v(?:ersion|\.)? ?3\.01
python-2.0 | 80 | python | (?:python software foundation|psf) license,? v(?:ersion|\.)? ?2
ruby | 80 | ruby | ruby s? ?license
ofl-1.0 | 80 | open font | (?:sil )?open font license,? v(?:ersion|\.)? ?1\.0
ofl-1.1 | 80 | open font | (?:sil )?open font license,? v(?:ersion|\.)? ?1\.1
ms-pl | 80 | microsoft public | microsoft public license
ms-rl | 80 | microsoft reciprocal | microsoft reciprocal license
ms-lpl | 80 | microsoft limited | microsoft limited public license
nasa-1.3 | 80 | nasa | nasa open source agreement,? v(?:ersion|\.)? ?1\.3
sspl-1.0 | 80 | server side | server side public license(?:,? v(?:ersion|\.)? ?1)?
busl-1.1 | 80 | business source | business source license(?:,? v(?:ersion|\.)? ?)?1\.1
elastic-2.0 | 80 | elastic | elastic license,? (?:v(?:ersion|\.)? ?)?2(?:\.0)?
confluent-1.0 | 80 | confluent | confluent community license(?: agreement)?,? v(?:ersion|\.)? ?1\.0
polyform-nc-1.0.0 | 80 | polyform | polyform noncommercial license 1\.0\.0
polyform-sb-1.0.0 | 80 | polyform | polyform small business license 1\.0\.0
polyform-shield-1.0.0 | 80 | polyform | polyform shield license 1\.0\.0
parity-7.0.0 | 80 | parity | parity public license 7\.0\.0
blueoak-1.0.0 | 80 | blue oak | blue oak model license(?: 1\.0\.0)?
upl-1.0 | 80 | universal permissive | universal permissive license(?:,? v(?:ersion|\.)? ?1\.0)?
ecl-2.0 | 80 | educational community | educational community license,? v(?:ersion|\.)? ?2\.0
cecill-2.0 | 80 | cecill | cecill(?: free software license agreement)?,? v(?:ersion|\.)? ?2\.0
cecill-2.1 | 80 | cecill | cecill(?: free software license agreement)?,? v(?:ersion|\.)? ?2\.1
cecill-b | 80 | cecill | cecill b\b
cecill-c | 80 | cecill | cecill c\b
mulan-psl-2.0 | 80 | mulan | mulan (?:psl|permissive software license),? v(?:ersion|\.)? ?2
odbl-1.0 | 80 | open database | open database license(?: \(?odbl\)?)?(?:,? v(?:ersion|\.)? ?1\.0)?
odc-by-1.0 | 80 | open data commons | open data commons attribution license
pddl-1.0 | 80 | open data commons | open data commons public domain dedication
ogl-uk-1.0 | 80 | open government | open government licen[cs]e(?: v(?:ersion|\.)? ?)1\.0
ogl-uk-2.0 | 80 | open government | open government licen[cs]e(?: v(?:ersion|\.)? ?)2\.0
ogl-uk-3.0 | 80 | open government | open government licen[cs]e(?: v(?:ersion|\.)? ?)3\.0
etalab-2.0 | 80 | etalab | (?:licence ouverte|open licence) etalab(?:,? v(?:ersion|\.)? ?2\.0)?
dl-de-by-2.0 | 80 | datenlizenz | datenlizenz deutschland namensnennung (?:version )?2\.0
dl-de-zero-2.0 | 80 | datenlizenz | datenlizenz deutschland zero (?:version )?2\.0
openrail-m | 80 | openrail | openrail m?\b
bigscience-rail-1.0 | 80 | rail | bigscience rail license(?: v1\.0)?
llama-2 | 80 | llama 2 | llama 2 community license
llama-3 | 80 | llama 3 | llama 3(?:\.\d)? community license
gemma | 80 | gemma | gemma terms of use
hippocratic-2.1 | 80 | hippocratic | hippocratic license(?: version)? 2\.1
jpl-image | 80 | jpl | jpl image use policy
cc0-1.0 | 80 | cc0 | cc0(?: 1\.0)?(?: universal)?\b
cc0-1.0 | 80 | creativecommons | creativecommons org publicdomain zero 1\.0
cc-pdm-1.0 | 80 | creativecommons | creativecommons org publicdomain mark 1\.0
cc-by-1.0 | 80 | creativecommons | creativecommons org licenses by 1\.0
cc-by-2.0 | 80 | creativecommons | creativecommons org licenses by 2\.0
cc-by-2.5 | 80 | creativecommons | creativecommons org licenses by 2\.5
cc-by-3.0 | 80 | creativecommons | creativecommons org licenses by 3\.0
cc-by-4.0 | 80 | creativecommons | creativecommons org licenses by 4\.0
cc-by-sa-2.0 | 80 | creativecommons | creativecommons org licenses by sa 2\.0
cc-by-sa-2.5 | 80 | creativecommons | creativecommons org licenses by sa 2\.5
cc-by-sa-3.0 | 80 | creativecommons | creativecommons org licenses by sa 3\.0
cc-by-sa-4.0 | 80 | creativecommons | creativecommons org licenses by sa 4\.0
cc-by-nc-2.0 | 80 | creativecommons | creativecommons org licenses by nc 2\.0
cc-by-nc-3.0 | 80 | creativecommons | creativecommons org licenses by nc 3\.0
cc-by-nc-4.0 | 80 | creativecommons | creativecommons org licenses by nc 4\.0
cc-by-nd-2.0 | 80 | creativecommons | creativecommons org licenses by nd 2\.0
cc-by-nd-3.0 | 80 | creativecommons | creativecommons org licenses by nd 3\.0
cc-by-nd-4.0 | 80 | creativecommons | creativecommons org licenses by nd 4\.0
cc-by-nc-sa-2.0 | 80 | creativecommons | creativecommons org licenses by nc sa 2\.0
cc-by-nc-sa-3.0 | 80 | creativecommons | creativecommons org licenses by nc sa 3\.0
cc-by-nc-sa-4.0 | 80 | creativecommons | creativecommons org licenses by nc sa 4\.0
cc-by-nc-nd-3.0 | 80 | creativecommons | creativecommons org licenses by nc nd 3\.0
cc-by-nc-nd-4.0 | 80 | creativecommons | creativecommons org licenses by nc nd 4\.0
cc-by-2.0 | 80 | cc | cc by 2\.0\b
cc-by-3.0 | 80 | cc | cc by 3\.0\b
cc-by-4.0 | 80 | cc | cc by 4\.0\b
cc-by-sa-2.5 | 80 | cc | cc by sa 2\.5\b
cc-by-sa-3.0 | 80 | cc | cc by sa 3\.0\b
cc-by-sa-4.0 | 80 | cc | cc by sa 4\.0\b
cc-by-nc-3.0 | 80 | cc | cc by nc 3\.0\b
cc-by-nc-4.0 | 80 | cc | cc by nc 4\.0\b
cc-by-nd-4.0 | 80 | cc | cc by nd 4\.0\b
cc-by-nc-sa-3.0 | 80 | cc | cc by nc sa 3\.0\b
cc-by-nc-sa-4.0 | 80 | cc | cc by nc sa 4\.0\b
cc-by-nc-nd-4.0 | 80 | cc | cc by nc nd 4\.0\b
cc-by-4.0 | 80 | creative com | creative commons attribution(?: license)? 4\.0
cc-by-3.0 | 80 | creative com | creative commons attribution(?: license)? 3\.0
cc-by-sa-4.0 | 80 | creative com | creative commons attribution share ?alike(?: license)? 4\.0
cc-by-sa-3.0 | 80 | creative com | creative commons attribution share ?alike(?: license)? 3\.0
cc-by-nc-4.0 | 80 | creative com | creative commons attribution non ?commercial(?: license)? 4\.0
cc-by-nc-sa-4.0 | 80 | creative com | creative commons attribution non ?commercial share ?alike(?: license)? 4\.0
cc-by-nc-nd-4.0 | 80 | creative com | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: license)? 4\.0
cc-by-nd-4.0 | 80 | creative com | creative commons attribution no ?deriv(?:ative)?s(?: license)? 4\.0
mit | 70 | free of charge | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | 70 | substantial portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
isc | 70 | with or without fee | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
hpnd | 72 | without fee | permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose (?:is hereby granted )?without fee
bsd-3-clause | 70 | endorse or promote | may be used to endorse or promote products derived from this software without specific prior written permission
bsd-2-clause | 65 | source and binary | redistribution and use in source and binary forms with or without modification are permitted
bsd-4-clause | 72 | advertising materials | all advertising materials mentioning features or use of this software must display the following acknowledg
apache-2.0 | 70 | under the license | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
gpl | 65 | without even the | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license
lgpl | 67 | without even the | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license
agpl | 67 | without even the | without even the implied warranty of merchantability or fitness for a particular purpose see the gnu affero general public license
unlicense | 70 | released into the public | free and unencumbered software released into the public domain
wtfpl | 70 | do what the | do what the fuck you want to(?: public license)?
zlib | 70 | origin of this | the origin of this software must not be misrepresented you must not claim that you wrote the original software
boost-1.0 | 70 | machine executable | solely in the form of machine executable object code generated by a source language processor
beerware | 70 | beer | buy me a beer in return
json | 70 | good, not evil | the software shall be used for good,? not evil
ofl-1.1 | 70 | font software | the font software may be sold as part of a larger software package but no copy of one or more of the font software typefaces may be sold by itself
mpl-2.0 | 70 | mozilla | this source code form is subject to the terms of the mozilla public license
curl | 70 | curl | curl and libcurl are licensed under
postgresql | 70 | postgresql | postgresql is released under the postgresql license
cc0-1.0 | 70 | waived all | waived all copyright and related or neighboring rights
gpl | 60 | gnu gen | gnu general public licen[cs]e
lgpl | 62 | gnu les | gnu lesser general public licen[cs]e
lgpl | 62 | gnu lib | gnu library general public licen[cs]e
agpl | 62 | affero | (?:gnu )?affero general public licen[cs]e
gfdl | 60 | gnu fre | gnu free documentation licen[cs]e
gpl | 55 | gpl | \b(?:gnu )?gpl(?: ?v?[23](?:\.0)?)?\b
lgpl | 56 | lgpl | \blgpl(?: ?v?[23](?:\.[01])?)?\b
agpl | 56 | agpl | \bagpl(?: ?v?3(?:\.0)?)?\b
apache | 60 | apache | apache (?:software )?licen[cs]e
mit | 60 | licen | \b(?:the )?(?:mit|expat) licen[cs]e
mit | 58 | released | released under (?:the )?mit\b
isc | 60 | isc | \bisc licen[cs]e
x11 | 60 | x11 | \bx11 licen[cs]e
bsd | 60 | bsd | \bbsd(?: style)? licen[cs]e
mpl | 60 | mozilla | mozilla public licen[cs]e
epl | 60 | eclipse | eclipse public licen[cs]e
eupl | 60 | european union public | european union public licen[cs]e
cddl | 60 | common development | common development and distribution licen[cs]e
boost-1.0 | 60 | boost | boost software licen[cs]e
artistic | 60 | artistic | (?:perl )?artistic licen[cs]e
zlib | 60 | zlib | \bzlib(?: libpng)? licen[cs]e
unlicense | 60 | unlicense | \bthe unlicense\b
wtfpl | 60 | wtfpl | \bwtfpl\b
openssl | 60 | openssl | openssl(?: ssleay)? licen[cs]e
python | 60 | python | python(?: software foundation)? licen[cs]e
perl | 58 | perl | same terms as perl(?: itself)?
php | 60 | php | \bphp licen[cs]e
vim | 60 | vim | \bvim licen[cs]e
ofl | 60 | open font | (?:sil )?open font licen[cs]e
lppl | 60 | latex project | latex project public licen[cs]e
ncsa | 60 | illinois | university of illinois ncsa open source licen[cs]e
postgresql | 60 | postgresql | postgresql licen[cs]e
odbl | 60 | open database | open database licen[cs]e
ogl | 60 | open government | open government licen[cs]e
sspl | 60 | sspl | \bsspl\b
busl | 60 | business source | business source licen[cs]e
commons-clause | 60 | commons clause | commons clause(?: licen[cs]e condition)?
cc-by | 60 | cc | \bcc by\b
cc-by-sa | 61 | cc | \bcc by sa\b
cc-by-nc | 61 | cc | \bcc by nc\b
cc-by-nd | 61 | cc | \bcc by nd\b
cc-by-nc-sa | 62 | cc | \bcc by nc sa\b
cc-by-nc-nd | 62 | cc | \bcc by nc nd\b
cc-by | 60 | creative com | creative commons attribution
cc-by-sa | 61 | creative com | creative commons attribution share ?alike
cc-by-nc | 61 | creative com | creative commons attribution non ?commercial
cc-by-nc-sa | 62 | creative com | creative commons attribution non ?commercial share ?alike
creative-commons | 50 | creative com | creative commons licen[cs]e
public-domain | 50 | public domain | (?:in|into|to) the public domain
public-domain | 50 | public domain | public domain dedication
proprietary | 45 | all rights | copyright[^.]{0,80} all rights reserved
proprietary | 44 | proprietary | proprietary and confidential
proprietary | 44 | unauthorized | unauthorized copying of this file via any medium is strictly prohibited
free-restricted | 42 | non-commercial | for non commercial (?:use|purposes) only
free-restricted | 42 | academic | for academic (?:use|purposes) only
free-restricted | 42 | research | for research (?:use|purposes) only
other-license | 40 | licensed under | licensed under the (?:terms of the )?[a-z0-9.+-]{2,30} licen[cs]e
other-license | 40 | license | see the (?:accompanying )?licen[cs]e file
other-license | 40 | license | subject to the terms of the [a-z0-9.+-]{2,30} licen[cs]e
other-license | 40 | license | distributed under the (?:terms of the )?[a-z0-9.+-]{2,30} licen[cs]e
"""


class Signature(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: re.Pattern


def _compile(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("? ?", "?[^0-9a-z]{0,12}").replace(" ?", "[^0-9a-z]{0,12}").replace(" ", "[^0-9a-z]{1,12}"))


def _rules() -> tuple[Signature, ...]:
    out = []
    for line in _TABLE.strip().splitlines():
        label, priority, keyword, pattern = line.split(" | ", 3)
        out.append(Signature(label, int(priority), keyword, _compile(pattern)))
    return tuple(out)


RULES = _rules()
