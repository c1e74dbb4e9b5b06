"""Signature rules for licence notices, written by hand.

Each line: priority | keyword | label | regex. A rule runs only on texts that have its keyword, or one of
several parted by slashes, as a word; every match must hold one of them. The regex
matches the lower-case words of a text joined by single blanks, from a word's start to a word's end.
Priorities: 9 licence text, 8 grant or full notice, 7 identifier tag or address, 6 full name with version, 5 full name,
4 short name with version, 3 short name, 2 loose mention. The three base rules are marked by an exclamation mark.
"""

RULES = r"""
3!| mit | mit | mit license
3!| apache | apache | apache license
3!| general | gpl | general public license
9 | permission | mit | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
9 | software | mit | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
8 | mit | mit | (?:licensed|released|distributed|available|published) under (?:the )?(?:terms of the )?mit licen[sc]e
8 | mit | mit | (?:use|usage) of this source code is governed by an? mit style licen[sc]e
7 | spdx | mit | spdx license identifier mit
7 | opensource | mit | (?:https? )?(?:www )?opensource org licenses mit(?: license)?(?: php)?
5 | mit | mit | the mit licen[sc]e(?: mit)?
5 | expat | mit | expat licen[sc]e
3 | mit | mit | mit licen[sc]ed
3 | mit | mit | mit x11|x11 mit
2 | mit | mit | (?:license|licence) mit
9 | permission | isc | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
8 | isc | isc | (?:licensed|released|distributed) under (?:the )?isc licen[sc]e
7 | spdx | isc | spdx license identifier isc
7 | opensource | isc | opensource org licenses isc
5 | isc | isc | isc licen[sc]e
9 | apache | apache-2.0 | you may not use this file except in compliance with the license you may obtain a copy of the license at (?:http|https) www apache org licenses license 2 0
8 | apache | apache-2.0 | licensed under the apache licen[sc]e version 2(?: 0)?
8 | apache | apache-2.0 | (?:released|distributed|available|published) under (?:the )?(?:terms of the )?apache(?: software)? licen[sc]e(?: version)? 2(?: 0)?
8 | asf | apache-2.0 | licensed to the apache software foundation asf under one or more contributor license agreements
7 | spdx | apache-2.0 | spdx license identifier apache 2 0
7 | apache | apache-2.0 | (?:https? )?www apache org licenses license 2 0(?: txt| html)?
6 | apache | apache-2.0 | apache(?: software)? licen[sc]e (?:version |v )?2(?: 0)?
4 | apache | apache-2.0 | apache 2(?: 0)?(?: licen[sc]e)?
4 | asl | apache-2.0 | asl 2(?: 0)?
6 | apache | apache-1.1 | apache software licen[sc]e version 1 1
6 | apache | apache-1.0 | apache software licen[sc]e version 1 0
7 | spdx | apache-1.1 | spdx license identifier apache 1 1
5 | apache | apache | apache software licen[sc]e
3 | apache | apache | apache licen[sc]ed
9 | redistribution | bsd-2-clause | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
9 | endorse | bsd-3-clause | neither the name of .{1,120}? nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission
9 | advertising | bsd-4-clause | all advertising materials mentioning features or use of this software must display the following acknowledgement
8 | bsd | bsd-3-clause | use of this source code is governed by a bsd style licen[sc]e(?: that can be found in the license file)?
8 | bsd | bsd | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?bsd licen[sc]e
7 | spdx | bsd-2-clause | spdx license identifier bsd 2 clause
7 | spdx | bsd-3-clause | spdx license identifier bsd 3 clause
7 | spdx | 0bsd | spdx license identifier 0bsd
7 | opensource | bsd-3-clause | opensource org licenses bsd 3 clause
7 | opensource | bsd-2-clause | opensource org licenses bsd 2 clause
7 | opensource | bsd | opensource org licenses bsd license(?: php)?
6 | bsd | bsd-2-clause | (?:bsd 2 clause|2 clause bsd|two clause bsd|simplified bsd)(?: licen[sc]e)?
6 | bsd | bsd-3-clause | (?:bsd 3 clause|3 clause bsd|three clause bsd|new bsd|revised bsd|modified bsd)(?: licen[sc]e)?
6 | bsd | bsd-4-clause | (?:bsd 4 clause|4 clause bsd|original bsd)(?: licen[sc]e)?
6 | freebsd | bsd-2-clause | freebsd licen[sc]e
5 | bsd/0bsd | 0bsd | (?:zero clause bsd(?: licen[sc]e)?|0bsd)
5 | bsd | bsd | bsd(?: style)? licen[sc]e
3 | bsd | bsd | bsd licen[sc]ed
8 | gnu | gpl-3.0-or-later | it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
8 | gnu | gpl-2.0-or-later | it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
8 | gnu | gpl-2.0-only | it under the terms of the gnu general public license version 2 as published by the free software foundation
8 | gnu | gpl-3.0-only | it under the terms of the gnu general public license version 3 as published by the free software foundation
8 | gnu | gpl-3.0 | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[sc]e(?: version)? v?3(?: 0)?
8 | gnu | gpl-2.0 | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?gnu general public licen[sc]e(?: version)? v?2(?: 0)?
8 | general | gpl | (?:licensed|released|distributed) under (?:the )?(?:terms of the )?(?:gnu )?general public licen[sc]e
7 | spdx | gpl-3.0-only | spdx license identifier gpl 3 0(?: only)?
7 | spdx | gpl-3.0-or-later | spdx license identifier gpl 3 0 or later
7 | spdx | gpl-2.0-only | spdx license identifier gpl 2 0(?: only)?
7 | spdx | gpl-2.0-or-later | spdx license identifier gpl 2 0 or later
7 | gnu | gpl | (?:https? )?www gnu org licenses(?: gpl(?: html| txt)?)?
7 | gnu | gpl-3.0 | www gnu org licenses gpl 3 0(?: html| txt| en html)?
7 | gnu | gpl-2.0 | www gnu org licenses(?: old licenses)? gpl 2 0(?: html| txt| en html)?
6 | general | gpl-3.0 | (?:gnu )?general public licen[sc]e(?: gpl)? (?:version |v )?3(?: 0)?
6 | general | gpl-2.0 | (?:gnu )?general public licen[sc]e(?: gpl)? (?:version |v )?2(?: 0)?
6 | general | gpl-1.0 | (?:gnu )?general public licen[sc]e(?: gpl)? (?:version |v )?1(?: 0)?
5 | gnu | gpl | gnu general public licen[sc]e
4 | gplv3 | gpl-3.0 | gplv3(?: 0)?
4 | gplv2 | gpl-2.0 | gplv2(?: 0)?
4 | gpl | gpl-3.0 | gpl (?:version |v )?3(?: 0)?
4 | gpl | gpl-2.0 | gpl (?:version |v )?2(?: 0)?
3 | gpl | gpl | (?:gnu )?gpl licen[sc]ed?
3 | gpl | gpl | gnu gpl
2 | gpl | gpl | under (?:the )?gpl
8 | lesser | lgpl-2.1-or-later | it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
8 | lesser | lgpl-3.0-or-later | it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
8 | library | lgpl-2.0-or-later | it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
7 | spdx | lgpl-2.1 | spdx license identifier lgpl 2 1(?: only| or later)?
7 | spdx | lgpl-3.0 | spdx license identifier lgpl 3 0(?: only| or later)?
7 | gnu | lgpl | www gnu org licenses lgpl(?: html| txt)?
7 | gnu | lgpl-3.0 | www gnu org licenses lgpl 3 0(?: html| txt)?
6 | lesser | lgpl-3.0 | (?:gnu )?lesser general public licen[sc]e(?: lgpl)? (?:version |v )?3(?: 0)?
6 | lesser | lgpl-2.1 | (?:gnu )?lesser general public licen[sc]e(?: lgpl)? (?:version |v )?2 1
6 | library | lgpl-2.0 | (?:gnu )?library general public licen[sc]e(?: (?:version |v )?2(?: 0)?)?
5 | lesser | lgpl | (?:gnu )?lesser general public licen[sc]e
4 | lgplv3 | lgpl-3.0 | lgplv3(?: 0)?
4 | lgpl | lgpl-2.1 | lgpl (?:version |v )?2 1
4 | lgpl | lgpl-3.0 | lgpl (?:version |v )?3(?: 0)?
3 | lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]ed?)?
8 | affero | agpl-3.0-or-later | it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
7 | spdx | agpl-3.0 | spdx license identifier agpl 3 0(?: only| or later)?
7 | gnu | agpl-3.0 | www gnu org licenses agpl(?: 3 0)?(?: html| txt)?
6 | affero | agpl-3.0 | (?:gnu )?affero general public licen[sc]e(?: agpl)? (?:version |v )?3(?: 0)?
5 | affero | agpl | (?:gnu )?affero general public licen[sc]e
4 | agplv3 | agpl-3.0 | agplv3(?: 0)?
3 | agpl | agpl | (?:gnu )?agpl(?: licen[sc]ed?)?
8 | gnu | gfdl | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
7 | spdx | gfdl | spdx license identifier gfdl 1 [123](?: only| or later)?
6 | documentation | gfdl-1.3 | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 3
6 | documentation | gfdl-1.2 | (?:gnu )?free documentation licen[sc]e (?:version |v )?1 2
5 | documentation | gfdl | (?:gnu )?free documentation licen[sc]e
3 | gfdl | gfdl | gfdl
8 | mozilla | mpl-2.0 | this source code form is subject to the terms of the mozilla public license v 2 0
8 | mozilla | mpl-1.1 | the contents of this file are subject to the mozilla public license version 1 1
7 | spdx | mpl-2.0 | spdx license identifier mpl 2 0
7 | spdx | mpl-1.1 | spdx license identifier mpl 1 1
7 | mozilla | mpl-2.0 | (?:https? )?(?:www )?mozilla org mpl 2 0
7 | mozilla | mpl | (?:https? )?(?:www )?mozilla org mpl
6 | mozilla | mpl-2.0 | mozilla public licen[sc]e(?: mpl)? (?:version |v )?2(?: 0)?
6 | mozilla | mpl-1.1 | mozilla public licen[sc]e(?: mpl)? (?:version |v )?1 1
5 | mozilla | mpl | mozilla public licen[sc]e
4 | mpl | mpl-2.0 | mpl (?:version |v )?2(?: 0)?
3 | mpl | mpl | mpl licen[sc]ed?
8 | eclipse | epl-1.0 | made available under the terms of the eclipse public license v1 0
8 | eclipse | epl-2.0 | made available under the terms of the eclipse public license (?:v )?2 0
7 | spdx | epl-2.0 | spdx license identifier epl 2 0
7 | spdx | epl-1.0 | spdx license identifier epl 1 0
6 | eclipse | epl-2.0 | eclipse public licen[sc]e(?: epl)? (?:version |v )?2(?: 0)?
6 | eclipse | epl-1.0 | eclipse public licen[sc]e(?: epl)? (?:version |v )?1(?: 0)?
5 | eclipse | epl | eclipse public licen[sc]e
5 | eclipse | edl-1.0 | eclipse distribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?
4 | epl | epl-2.0 | epl (?:version |v )?2(?: 0)?
4 | epl | epl-1.0 | epl (?:version |v )?1(?: 0)?
7 | spdx | cddl-1.0 | spdx license identifier cddl 1 [01]
6 | cddl | cddl-1.0 | common development and distribution licen[sc]e cddl (?:version |v )?1 0
5 | development | cddl | common development and distribution licen[sc]e
3 | cddl | cddl | cddl(?: 1 [01])?
5 | common | cpl-1.0 | common public licen[sc]e(?: (?:version |v )?1(?: 0)?)?
5 | common | cpal-1.0 | common public attribution licen[sc]e(?: (?:version |v )?1(?: 0)?)?
5 | ibm | ipl-1.0 | ibm public licen[sc]e(?: (?:version |v )?1(?: 0)?)?
5 | microsoft | ms-pl | microsoft public licen[sc]e(?: ms pl)?
5 | microsoft | ms-rl | microsoft reciprocal licen[sc]e(?: ms rl)?
7 | spdx | ms-pl | spdx license identifier ms pl
8 | boost | bsl-1.0 | distributed under the boost software license version 1 0
7 | spdx | bsl-1.0 | spdx license identifier bsl 1 0
7 | boost | bsl-1.0 | (?:https? )?www boost org license 1 0 txt
6 | boost | bsl-1.0 | boost software licen[sc]e(?: (?:version |v )?1(?: 0)?)?
9 | unencumbered | unlicense | this is free and unencumbered software released into the public domain
7 | spdx | unlicense | spdx license identifier unlicense
7 | unlicense | unlicense | (?:https? )?unlicense org
5 | unlicense | unlicense | the unlicense
8 | fuck | wtfpl | do what the fuck you want to public licen[sc]e
3 | wtfpl | wtfpl | wtfpl
9 | liable | zlib | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
7 | spdx | zlib | spdx license identifier zlib
5 | zlib | zlib | zlib(?: libpng)? licen[sc]e
5 | libpng | libpng | libpng licen[sc]e
5 | artistic | artistic-2.0 | artistic licen[sc]e (?:version |v )?2(?: 0)?
4 | artistic | artistic | (?:the )?artistic licen[sc]e
7 | spdx | artistic-2.0 | spdx license identifier artistic 2 0
8 | perl | perl | (?:free software you can redistribute it and or modify it )?under the same terms as perl(?: itself)?
8 | psf | psf | licensed to psf under a contributor agreement
6 | python | psf-2.0 | python software foundation licen[sc]e(?: version 2)?
5 | psf/python | psf | (?:psf|python) licen[sc]e(?: agreement)?
5 | ruby | ruby | ruby licen[sc]e
5 | php | php-3.01 | php licen[sc]e(?: version)?(?: 3 0?1)?
8 | php | php-3.01 | this source file is subject to version 3 0?1 of the php license
5 | w3c | w3c | w3c(?: software)?(?: notice and)? licen[sc]e
5 | openssl | openssl | openssl licen[sc]e
5 | ncsa | ncsa | (?:university of illinois )?ncsa(?: open source)? licen[sc]e
7 | spdx | ncsa | spdx license identifier ncsa
5 | postgresql | postgresql | postgresql licen[sc]e
5 | curl | curl | curl licen[sc]e
5 | vim | vim | vim licen[sc]e
5 | sleepycat | sleepycat | sleepycat licen[sc]e
5 | academic | afl-3.0 | academic free licen[sc]e(?: (?:version |v )?3(?: 0)?)?
5 | software | osl-3.0 | open software licen[sc]e(?: osl)?(?: (?:version |v )?3(?: 0)?)?
6 | european | eupl-1.2 | european union public licen[sc]e(?: eupl)?(?: (?:version |v )?1 [12])?
3 | eupl | eupl | eupl(?: 1 [12]| v1 [12])?
5 | cecill | cecill | cecill(?: [abc])?(?: (?:version |v )?2(?: [01])?)?
5 | font | ofl-1.1 | (?:sil )?open font licen[sc]e(?: ofl)?(?: (?:version |v )?1 1)?
8 | sil | ofl-1.1 | this font software is licensed under the sil open font license(?: version 1 1)?
7 | scripts | ofl-1.1 | (?:https? )?scripts sil org ofl
5 | ubuntu | ubuntu-font | ubuntu font licen[sc]e(?: 1 0)?
5 | bitstream | bitstream-vera | bitstream vera(?: fonts)?(?: copyright| licen[sc]e)
5 | permissive | upl-1.0 | universal permissive licen[sc]e(?: upl)?(?: (?:version |v )?1(?: 0)?)?
5 | blue | blueoak-1.0.0 | blue oak model licen[sc]e(?: 1 0 0)?
8 | business | busl-1.1 | business source licen[sc]e(?: (?:version |v )?1 1)?
7 | spdx | busl-1.1 | spdx license identifier busl 1 1
8 | elastic | elastic-2.0 | elastic licen[sc]e(?: (?:version |v )?2(?: 0)?)?
8 | server | sspl-1.0 | server side public licen[sc]e(?: sspl)?(?: (?:version |v )?1)?
3 | sspl | sspl-1.0 | sspl(?: v?1)?
8 | commons | commons-clause | commons clause(?: licen[sc]e condition)?(?: v1 0)?
8 | polyform | polyform | polyform (?:noncommercial|small business|shield|perimeter|strict|free trial) licen[sc]e(?: 1 0 0)?
8 | creative | cc-by-4.0 | (?:licensed|released|available|distributed) under (?:a |the )?creative commons attribution 4 0(?: international)?(?: licen[sc]e)?
8 | creative | cc-by-sa-4.0 | (?:licensed|released|available|distributed) under (?:a |the )?creative commons attribution share ?alike 4 0(?: international)?(?: licen[sc]e)?
7 | creativecommons | cc-by-nc-nd-4.0 | (?:https? )?creativecommons org licenses by nc nd 4 0
7 | creativecommons | cc-by-nc-sa-4.0 | (?:https? )?creativecommons org licenses by nc sa 4 0
7 | creativecommons | cc-by-nc-4.0 | (?:https? )?creativecommons org licenses by nc 4 0
7 | creativecommons | cc-by-nd-4.0 | (?:https? )?creativecommons org licenses by nd 4 0
7 | creativecommons | cc-by-sa-4.0 | (?:https? )?creativecommons org licenses by sa 4 0
7 | creativecommons | cc-by-4.0 | (?:https? )?creativecommons org licenses by 4 0
7 | creativecommons | cc-by-nc-nd-3.0 | (?:https? )?creativecommons org licenses by nc nd 3 0
7 | creativecommons | cc-by-nc-sa-3.0 | (?:https? )?creativecommons org licenses by nc sa 3 0
7 | creativecommons | cc-by-nc-3.0 | (?:https? )?creativecommons org licenses by nc 3 0
7 | creativecommons | cc-by-sa-3.0 | (?:https? )?creativecommons org licenses by sa 3 0
7 | creativecommons | cc-by-3.0 | (?:https? )?creativecommons org licenses by 3 0
7 | creativecommons | cc-by-2.0 | (?:https? )?creativecommons org licenses by 2 [05]
7 | creativecommons | cc0-1.0 | (?:https? )?creativecommons org publicdomain zero 1 0
7 | creativecommons | pdm-1.0 | (?:https? )?creativecommons org publicdomain mark 1 0
7 | spdx | cc-by-4.0 | spdx license identifier cc by 4 0
7 | spdx | cc-by-sa-4.0 | spdx license identifier cc by sa 4 0
7 | spdx | cc-by-nc-4.0 | spdx license identifier cc by nc 4 0
7 | spdx | cc0-1.0 | spdx license identifier cc0 1 0
6 | creative | cc-by-nc-nd | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?
6 | creative | cc-by-nc-sa | creative commons attribution non ?commercial share ?alike(?: [1234] [05])?
6 | creative | cc-by-nc | creative commons attribution non ?commercial(?: [1234] [05])?
6 | creative | cc-by-nd | creative commons attribution no ?deriv(?:ative)?s(?: works)?(?: [1234] [05])?
6 | creative | cc-by-sa | creative commons attribution share ?alike(?: [1234] [05])?
6 | creative | cc-by | creative commons attribution(?: [1234] [05])?(?: international| unported)?(?: licen[sc]e)?
6 | creative | cc0-1.0 | creative commons (?:zero|cc0|public domain dedication)(?: (?:v )?1 0)?(?: universal)?
4 | creative | cc | creative commons licen[sc]e
4 | cc | cc-by-nc-nd-4.0 | cc by nc nd 4 0
4 | cc | cc-by-nc-sa-4.0 | cc by nc sa 4 0
4 | cc | cc-by-nc-4.0 | cc by nc 4 0
4 | cc | cc-by-nd-4.0 | cc by nd 4 0
4 | cc | cc-by-sa-4.0 | cc by sa 4 0
4 | cc | cc-by-4.0 | cc by 4 0
4 | cc | cc-by-sa-3.0 | cc by sa 3 0
4 | cc | cc-by-3.0 | cc by 3 0
4 | cc | cc-by-nc-3.0 | cc by nc 3 0
4 | cc | cc-by-nc-sa-3.0 | cc by nc sa 3 0
3 | cc | cc-by-nc-nd | cc by nc nd
3 | cc | cc-by-nc-sa | cc by nc sa
3 | cc | cc-by-nc | cc by nc
3 | cc | cc-by-nd | cc by nd
3 | cc | cc-by-sa | cc by sa
3 | cc0 | cc0-1.0 | cc0(?: 1 0)?(?: universal)?
8 | database | odbl-1.0 | open (?:data commons open )?database licen[sc]e(?: odbl)?(?: (?:version |v )?1 0)?
3 | odbl | odbl-1.0 | odbl(?: 1 0)?
5 | attribution | odc-by-1.0 | open data commons attribution licen[sc]e(?: odc by)?(?: v1 0)?
5 | pddl | pddl-1.0 | (?:public domain dedication and licen[sc]e )?pddl(?: 1 0)?
6 | government | ogl-uk-3.0 | open government licen[sc]e(?: ogl)?(?: v ?3 0)?
5 | community | cdla-permissive | community data licen[sc]e agreement permissive(?: (?:version )?[12] 0)?
5 | community | cdla-sharing | community data licen[sc]e agreement sharing(?: (?:version )?1 0)?
8 | public | public-domain | (?:released|placed|dedicated) (?:in|into|to) the public domain
5 | public | public-domain | this (?:work|file|code|program|document) is (?:in|hereby placed in) the public domain
8 | rail | openrail | (?:creativeml )?open rail(?: m)?(?: licen[sc]e)?
5 | openrail | openrail | (?:bigscience |creativeml )?openrail(?: m)?(?: licen[sc]e)?
6 | llama | llama | llama (?:2|3|3 1|3 2) community licen[sc]e(?: agreement)?
6 | gemma | gemma | gemma terms of use
8 | rights | proprietary | all rights reserved
8 | confidential | proprietary | (?:proprietary and confidential|confidential and proprietary)
8 | reproduced/copied/distributed | proprietary | (?:may not|must not|no part of this .{1,40}? may) be (?:reproduced|copied|distributed)(?: .{1,60}?)? without (?:the )?(?:prior |express )?(?:written )?(?:permission|consent)
5 | user/proprietary | proprietary | (?:end user licen[sc]e agreement|proprietary licen[sc]e)
5 | eula | proprietary | eula
2 | copyright | copyright | copyright(?: c)? (?:19|20)[0-9]{2}(?: (?:19|20)[0-9]{2})?
"""
