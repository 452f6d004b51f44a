"""Signatures of licences, written by hand for ``licenses``.

One rule a line: level, gates, label, pattern.  A pattern is a regular expression over words
(lower-case, without punctuation) with one blank between them; it begins and ends with whole
words.  Every match holds one of the gates as a word, so a text without them needs no look at
the rule.  Levels, strongest first: 1 identifier, 2 passage of a licence's own text,
3 notice that puts something under a licence, 4 name or address of a licence, 5 hint.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

RULES_TEXT = r"""
1 spdx mit: spdx license identifier mit
1 spdx mit-0: spdx license identifier mit 0
1 spdx apache-2.0: spdx license identifier apache 2 0
1 spdx apache-1.1: spdx license identifier apache 1 1
1 spdx gpl-2.0: spdx license identifier gpl 2 0(?: only)?
1 spdx gpl-2.0-or-later: spdx license identifier gpl 2 0 or later
1 spdx gpl-3.0: spdx license identifier gpl 3 0(?: only)?
1 spdx gpl-3.0-or-later: spdx license identifier gpl 3 0 or later
1 spdx lgpl-2.1: spdx license identifier lgpl 2 1(?: only| or later)?
1 spdx lgpl-3.0: spdx license identifier lgpl 3 0(?: only| or later)?
1 spdx agpl-3.0: spdx license identifier agpl 3 0(?: only| or later)?
1 spdx bsd-2-clause: spdx license identifier bsd 2 clause
1 spdx bsd-3-clause: spdx license identifier bsd 3 clause
1 spdx 0bsd: spdx license identifier 0bsd
1 spdx isc: spdx license identifier isc
1 spdx mpl-2.0: spdx license identifier mpl 2 0
1 spdx mpl-1.1: spdx license identifier mpl 1 1
1 spdx epl-1.0: spdx license identifier epl 1 0
1 spdx epl-2.0: spdx license identifier epl 2 0
1 spdx eupl-1.2: spdx license identifier eupl 1 2
1 spdx cddl-1.0: spdx license identifier cddl 1 0
1 spdx unlicense: spdx license identifier unlicense
1 spdx zlib: spdx license identifier zlib
1 spdx bsl-1.0: spdx license identifier bsl 1 0
1 spdx wtfpl: spdx license identifier wtfpl
1 spdx artistic-2.0: spdx license identifier artistic 2 0
1 spdx cc0-1.0: spdx license identifier cc0 1 0
1 spdx cc-by-4.0: spdx license identifier cc by 4 0
1 spdx cc-by-sa-4.0: spdx license identifier cc by sa 4 0
1 spdx cc-by-nc-4.0: spdx license identifier cc by nc 4 0
1 spdx ofl-1.1: spdx license identifier ofl 1 1
1 spdx python-2.0: spdx license identifier (?:python|psf) 2 0
1 spdx ms-pl: spdx license identifier ms pl
1 spdx postgresql: spdx license identifier postgresql
1 spdx ncsa: spdx license identifier ncsa
1 spdx odbl-1.0: spdx license identifier odbl 1 0
1 identifier other-spdx: spdx license identifier \S+
2 permission mit: permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
2 copyright mit: the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
2 merchantability mit: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
2 dealings mit: out of or in connection with the software or the use or other dealings in the software
2 permission isc: permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 permission isc: permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted
2 permission ntp: permission to use copy modify and distribute this software and its documentation for any purpose
2 redistribution bsd: redistribution and use in source and binary forms with or without modification are permitted
2 redistributions bsd: redistributions of source code must retain the above copyright notice
2 redistributions bsd: redistributions in binary form must reproduce the above copyright notice
2 endorse bsd-3-clause: neither the name of (?:\S+ ){1,12}nor the names of its contributors may be used to endorse or promote products
2 advertising bsd-4-clause: all advertising materials mentioning features or use of this software must display
2 derived apache-1.1: products derived from this software may not be called apache
2 perpetual apache-2.0: each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:copyright|patent) license
2 distributed apache-2.0: unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
2 compliance apache-2.0: you may not use this file except in compliance with the license
2 conditions apache-2.0: terms and conditions for use reproduction and distribution
2 redistribute gpl: this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
2 redistribute lgpl: this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
2 redistribute agpl: you can redistribute it and or modify it under the terms of the gnu affero general public license
2 hope gpl: (?:this program|it) is distributed in the hope that it will be useful but without any warranty
2 option gpl-2.0-or-later: either version 2 of the license or at your option any later version
2 option gpl-3.0-or-later: either version 3 of the license or at your option any later version
2 option lgpl-2.1-or-later: either version 2 1 of the license or at your option any later version
2 received gpl: you should have received a copy of the gnu general public license
2 received lgpl: you should have received a copy of the gnu (?:lesser|library) general public license
2 received agpl: you should have received a copy of the gnu affero general public license
2 copyleft gpl: the gnu general public license is a free copyleft license for software and other kinds of works
2 freedom gpl: the licenses for most software (?:and other practical works )?are designed to take away your freedom
2 network agpl: specifically designed to ensure cooperation with the community in the case of network server software
2 incorporates lgpl-3.0: this version of the gnu lesser general public license incorporates the terms and conditions of version 3
2 subject mpl-2.0: this source code form is subject to the terms of the mozilla public license v 2 0
2 mozilla mpl-1.1: the contents of this file are subject to the mozilla public license version 1 1
2 netscape npl-1.1: the contents of this file are subject to the netscape public license
2 accompanying epl: the accompanying program is provided under the terms of this eclipse public license
2 eclipse epl-2.0: this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |v|version )?2 0
2 eclipse epl-1.0: this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |v|version )?1 0
2 unencumbered unlicense: this is free and unencumbered software released into the public domain
2 dedicate unlicense: (?:the )?authors? of this software dedicate any and all copyright interest in the software to the public domain
2 arising zlib: in no event will the authors be held liable for any damages arising from the use of this software
2 misrepresented zlib: the origin of this software must not be misrepresented
2 altered zlib: altered source versions must be plainly marked as such
2 boost bsl-1.0: boost software license version 1 0 august 17th 2003
2 executable bsl-1.0: solely in the form of machine executable object code generated by a source language processor
2 fuck wtfpl: you just do what the fuck you want to
2 derivatives ofl-1.1: the fonts? and derivatives may be bundled embedded redistributed and or sold
2 font ofl-1.1: this font software is licensed under the sil open font license version 1 1
2 waived cc0-1.0: to the extent possible under law (?:\S+ ){1,12}has waived all copyright and related or neighboring rights
2 affirmer cc0-1.0: affirmer hereby overtly fully permanently irrevocably and unconditionally waives
2 share cc: you are free to share copy and redistribute the material in any medium or format
2 adapt cc: adapt remix transform and build upon the material
2 credit cc-by: you must give appropriate credit provide a link to the license and indicate if changes were made
2 commercial cc-by-nc: you may not use the material for commercial purposes
2 contributions cc-by-sa: you must distribute your contributions under the same license as the original
2 modified cc-by-nd: you may not distribute the modified material
2 artistic artistic: the artistic license preamble
2 everyone gpl: everyone is permitted to copy and distribute verbatim copies of this license document
2 python python-2.0: this license agreement is between the python software foundation psf and the individual or organization
2 european eupl: this european union public licence the eupl applies to the work
2 supplied cddl-1.0: this file and its contents are supplied under the terms of the common development and distribution license
2 california postgresql: (?:in no event shall the )?university of california be liable to any party for direct indirect special incidental or consequential damages
2 database odbl-1.0: this database is made available under the open database license
2 illinois ncsa: university of illinois ncsa open source license
2 openssl openssl: this product includes software developed by the openssl project
2 unicode unicode: unicode data files and software
2 accompanied sleepycat: redistributions in any form must be accompanied by information on how to obtain complete source code
2 evil json: the software shall be used for good not evil
2 beer beerware: if we meet some day and you think this stuff is worth it you can buy me a beer
2 postcard postcardware: (?:please )?send me a postcard
2 copies verbatim: permission is granted to make and distribute verbatim copies
2 copying fsfap: copying and distribution of this file with or without modification are permitted in any medium without royalty
2 unlimited fsful: this file is free software the free software foundation gives unlimited permission to copy and or distribute it
2 unauthorized proprietary: unauthorized copying of this file via any medium is strictly prohibited
2 confidential proprietary: proprietary and confidential
2 reproduced proprietary: no part of this (?:publication|book|work|document|site) may be reproduced
2 written proprietary: without (?:the )?(?:prior )?(?:express )?written (?:permission|consent) of the (?:publisher|author|owner|copyright holder)
3 mit mit: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mit(?: license)?
3 apache apache-2.0: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache license (?:version |v)?2(?: 0)?
3 apache apache: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?apache(?: license)?
3 gnu gpl-3.0: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu general public license (?:version |v)?3(?: 0)?
3 gnu gpl-2.0: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu general public license (?:version |v)?2(?: 0)?
3 gnu gpl: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu general public license
3 gnu lgpl: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?gnu (?:lesser|library) general public license
3 affero agpl: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?affero general public license
3 gpl gpl: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?gpl
3 gpl,gplv2,gpl2 gpl-2.0: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl (?:v|version )?2|gplv2|gpl2)(?: 0)?
3 gpl,gplv3,gpl3 gpl-3.0: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?(?:gnu )?(?:gpl (?:v|version )?3|gplv3|gpl3)(?: 0)?
3 bsd bsd: (?:licensed|released|distributed|available|published|provided) under (?:the |a )?(?:terms of the )?bsd(?: style)?(?: license)?
3 mozilla mpl: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?mozilla public license
3 eclipse epl: (?:licensed|released|distributed|available|published|provided) under (?:the )?(?:terms of the )?eclipse public license
3 creative cc: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:terms of the )?creative commons
3 cc cc-by: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by
3 cc cc-by-sa: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by sa
3 cc cc-by-nc: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nc
3 cc cc-by-nd: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nd
3 cc cc-by-4.0: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by 4 0
3 cc cc-by-sa-4.0: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by sa 4 0
3 cc cc-by-nc-4.0: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nc 4 0
3 cc cc-by-nd-4.0: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nd 4 0
3 cc cc-by-nc-sa-4.0: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nc sa 4 0
3 cc cc-by-nc-nd-4.0: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?cc by nc nd 4 0
3 domain public-domain: (?:released|placed|dedicated|put) (?:in|into|to) the public domain
3 dual dual: dual licensed under
3 perl perl: under the same terms as perl(?: itself)?
3 proprietary,commercial proprietary: (?:licensed|released|distributed|available|published|provided) under (?:a |the )?(?:proprietary|commercial) licen[cs]e
3 licensed gpl: this work is licensed under the gnu general public license
3 licensed gpl-3.0: this work is licensed under the gnu general public license version 3(?: 0)?
3 licensed gpl-2.0: this work is licensed under the gnu general public license version 2(?: 0)?
4 mit mit: (?:the )?mit licen[cs]e
4 mit mit: mit x11 licen[cs]e
4 expat mit: expat licen[cs]e
4 attribution mit-0: mit no attribution
4 opensource mit: opensource org licenses? mit(?: license)?(?: php| html)?
4 apache apache: (?:the )?apache(?: software)? licen[cs]e
4 apache apache-2.0: (?:the )?apache(?: software)? licen[cs]e (?:version |v)?2(?: 0)?
4 apache apache-2.0: apache 2 0
4 apache apache-1.1: (?:the )?apache(?: software)? licen[cs]e (?:version |v)?1 1
4 apache apache-1.0: (?:the )?apache(?: software)? licen[cs]e (?:version |v)?1 0
4 apache apache-2.0: apache org licenses license 2 0(?: txt| html)?
4 gnu gpl: (?:the )?gnu general public licen[cs]e
4 general gpl: (?:the )?general public licen[cs]e
4 general gpl-1.0: (?:the )?(?:gnu )?general public licen[cs]e (?:version |v)?1(?: 0)?
4 general gpl-2.0: (?:the )?(?:gnu )?general public licen[cs]e (?:version |v)?2(?: 0)?
4 general gpl-3.0: (?:the )?(?:gnu )?general public licen[cs]e (?:version |v)?3(?: 0)?
4 gnu gpl: gnu gpl
4 gpl,gplv2,gpl2 gpl-2.0: (?:gnu )?(?:gplv2|gpl v2|gpl 2|gpl2)(?: 0)?
4 gpl,gplv3,gpl3 gpl-3.0: (?:gnu )?(?:gplv3|gpl v3|gpl 3|gpl3)(?: 0)?
4 gpl,gplv2,gpl2 gpl-2.0-or-later: (?:gnu )?(?:gplv2|gpl v2|gpl 2|gpl2) or later
4 gpl,gplv3,gpl3 gpl-3.0-or-later: (?:gnu )?(?:gplv3|gpl v3|gpl 3|gpl3) or later
4 gnu gpl: gnu org (?:licenses|copyleft) gpl(?: html| txt)?
4 lesser lgpl: (?:the )?(?:gnu )?lesser general public licen[cs]e
4 library lgpl: (?:the )?(?:gnu )?library general public licen[cs]e
4 lesser lgpl-2.1: (?:the )?(?:gnu )?lesser general public licen[cs]e (?:version |v)?2 1
4 lesser lgpl-3.0: (?:the )?(?:gnu )?lesser general public licen[cs]e (?:version |v)?3(?: 0)?
4 library lgpl-2.0: (?:the )?(?:gnu )?library general public licen[cs]e (?:version |v)?2(?: 0)?
4 lgpl lgpl: (?:gnu )?lgpl(?: licen[cs]e)?
4 lgpl,lgplv2,lgpl2 lgpl-2.1: (?:gnu )?(?:lgplv2|lgpl v2|lgpl 2|lgpl2) 1
4 lgpl,lgplv3,lgpl3 lgpl-3.0: (?:gnu )?(?:lgplv3|lgpl v3|lgpl 3|lgpl3)(?: 0)?
4 affero agpl: (?:the )?(?:gnu )?affero general public licen[cs]e
4 affero agpl-3.0: (?:the )?(?:gnu )?affero general public licen[cs]e (?:version |v)?3(?: 0)?
4 agpl agpl: (?:gnu )?agpl(?: licen[cs]e)?
4 agpl,agplv3,agpl3 agpl-3.0: (?:gnu )?(?:agplv3|agpl v3|agpl 3|agpl3)(?: 0)?
4 documentation gfdl: (?:the )?gnu free documentation licen[cs]e
4 gfdl gfdl: gfdl
4 classpath classpath-exception: classpath exception
4 bsd bsd: (?:the )?bsd licen[cs]e
4 bsd bsd-2-clause: bsd 2 clause(?: licen[cs]e)?
4 bsd bsd-2-clause: (?:2|two) clause bsd(?: licen[cs]e)?
4 bsd bsd-2-clause: simplified bsd(?: licen[cs]e)?
4 freebsd bsd-2-clause: freebsd licen[cs]e
4 bsd bsd-3-clause: bsd 3 clause(?: licen[cs]e)?
4 bsd bsd-3-clause: (?:3|three) clause bsd(?: licen[cs]e)?
4 bsd bsd-3-clause: (?:new|modified|revised) bsd(?: licen[cs]e)?
4 bsd bsd-4-clause: (?:4|four) clause bsd(?: licen[cs]e)?
4 bsd bsd-4-clause: (?:original|old) bsd(?: licen[cs]e)?
4 0bsd 0bsd: 0bsd(?: licen[cs]e)?
4 bsd 0bsd: zero clause bsd(?: licen[cs]e)?
4 isc isc: (?:the )?isc licen[cs]e
4 mozilla mpl: (?:the )?mozilla public licen[cs]e
4 mozilla mpl-1.1: (?:the )?mozilla public licen[cs]e (?:version |v ?)?1 1
4 mozilla mpl-2.0: (?:the )?mozilla public licen[cs]e (?:version |v ?)?2(?: 0)?
4 mozilla mpl-2.0: mozilla org mpl 2 0
4 mpl mpl-2.0: mpl (?:v ?)?2 0
4 eclipse epl: (?:the )?eclipse public licen[cs]e
4 eclipse epl-1.0: (?:the )?eclipse public licen[cs]e (?:version |v ?)?1 0
4 eclipse epl-2.0: (?:the )?eclipse public licen[cs]e (?:version |v ?)?2 0
4 eclipse edl-1.0: (?:the )?eclipse distribution licen[cs]e
4 eupl eupl: eupl
4 european eupl: european union public licen[cs]e
4 cecill cecill: (?:the )?cecill(?: [bc])?(?: licen[cs]e)?
4 common cddl-1.0: common development and distribution licen[cs]e
4 common cpl-1.0: common public licen[cs]e
4 ibm ipl-1.0: ibm public licen[cs]e
4 cddl cddl-1.0: cddl
4 unlicense unlicense: (?:the )?unlicense
4 unlicense unlicense: unlicense org
4 zlib zlib: (?:the )?zlib(?: libpng)? licen[cs]e
4 libpng libpng: (?:the )?libpng licen[cs]e
4 boost bsl-1.0: (?:the )?boost software licen[cs]e
4 business busl-1.1: (?:the )?business source licen[cs]e
4 server sspl-1.0: (?:the )?server side public licen[cs]e
4 elastic elastic-2.0: (?:the )?elastic licen[cs]e(?: 2 0)?
4 commons commons-clause: commons clause
4 wtfpl wtfpl: wtfpl
4 artistic artistic: (?:the )?artistic licen[cs]e
4 artistic artistic-2.0: (?:the )?artistic licen[cs]e (?:version )?2 0
4 perl perl: perl artistic licen[cs]e
4 python python-2.0: (?:the )?python software foundation licen[cs]e
4 php php-3.01: (?:the )?php licen[cs]e
4 ruby ruby: (?:the )?ruby licen[cs]e
4 openssl openssl: (?:the )?openssl licen[cs]e
4 postgresql postgresql: (?:the )?postgresql licen[cs]e
4 microsoft ms-pl: microsoft public licen[cs]e
4 microsoft ms-rl: microsoft reciprocal licen[cs]e
4 academic afl-3.0: academic free licen[cs]e
4 open osl-3.0: open software licen[cs]e
4 font ofl-1.1: (?:the )?(?:sil )?open font licen[cs]e
4 database odbl-1.0: (?:the )?open (?:data commons )?open database licen[cs]e
4 odbl odbl-1.0: odbl
4 government ogl: (?:the )?open government licen[cs]e
4 data odc-by: open data commons attribution licen[cs]e
4 design dsl: (?:the )?design science licen[cs]e
4 w3c w3c: (?:the )?w3c (?:software|document) (?:notice and )?licen[cs]e
4 unicode unicode: (?:the )?unicode licen[cs]e
4 intel intel: intel open source licen[cs]e
4 apple apsl-2.0: apple public source licen[cs]e
4 nasa nasa-1.3: nasa open source agreement
4 sun sissl: sun industry standards source licen[cs]e
4 lucent lpl-1.02: lucent public licen[cs]e
4 reciprocal rpl-1.5: reciprocal public licen[cs]e
4 mulan mulan-psl-2.0: mulan (?:psl|permissive software licen[cs]e)
4 llama llama: llama \S+ community licen[cs]e(?: agreement)?
4 openrail openrail: (?:creativeml |bigscience )?openrail(?: m)?(?: licen[cs]e)?
4 cc0 cc0-1.0: cc0(?: 1 0)?(?: universal)?
4 zero cc0-1.0: creative commons zero
4 creativecommons cc0-1.0: creativecommons org publicdomain zero 1 0
4 creativecommons cc-by: creativecommons org licenses by
4 creativecommons cc-by-4.0: creativecommons org licenses by 4 0
4 creativecommons cc-by-sa: creativecommons org licenses by sa
4 creativecommons cc-by-sa-4.0: creativecommons org licenses by sa 4 0
4 creativecommons cc-by-nc: creativecommons org licenses by nc
4 creativecommons cc-by-nc-4.0: creativecommons org licenses by nc 4 0
4 creativecommons cc-by-nd-4.0: creativecommons org licenses by nd 4 0
4 creativecommons cc-by-nc-sa-4.0: creativecommons org licenses by nc sa 4 0
4 creativecommons cc-by-nc-nd-4.0: creativecommons org licenses by nc nd 4 0
4 creative cc: creative commons(?: licen[cs]e)?
4 creative cc-by: creative commons attribution(?: \S+ \S+ international)?(?: licen[cs]e)?
4 alike,sharealike cc-by-sa: creative commons attribution share ?alike
4 alike,sharealike cc-by-nc-sa: creative commons attribution non ?commercial share ?alike
4 commercial,noncommercial cc-by-nc: creative commons attribution non ?commercial
4 deriv,derivs,derivative,derivatives,noderiv,noderivs,noderivative,noderivatives cc-by-nd: creative commons attribution no ?deriv(?:ative)?s?
4 cc cc-by: cc by
4 cc cc-by-3.0: cc by 3 0
4 cc cc-by-4.0: cc by 4 0
4 cc cc-by-sa: cc by sa
4 cc cc-by-sa-3.0: cc by sa 3 0
4 cc cc-by-sa-4.0: cc by sa 4 0
4 cc cc-by-nc: cc by nc
4 cc cc-by-nc-3.0: cc by nc 3 0
4 cc cc-by-nc-4.0: cc by nc 4 0
4 cc cc-by-nd: cc by nd
4 cc cc-by-nd-4.0: cc by nd 4 0
4 cc cc-by-nc-sa: cc by nc sa
4 cc cc-by-nc-sa-4.0: cc by nc sa 4 0
4 cc cc-by-nc-nd: cc by nc nd
4 cc cc-by-nc-nd-4.0: cc by nc nd 4 0
4 domain public-domain: (?:in the |into the )?public domain
5 reserved all-rights-reserved: all rights reserved
5 reserved some-rights-reserved: some rights reserved
5 reservados all-rights-reserved: todos los derechos reservados
5 réservés all-rights-reserved: tous droits r[éÉ]serv[éÉ]s
5 vorbehalten all-rights-reserved: alle rechte vorbehalten
5 copyright copyright: copyright (?:c )?(?:19|20)[0-9][0-9]
5 copyright copyright: copyright notice
5 copyright copyright: (?:protected by|violation of|subject to) copyright
5 details licence-file: see (?:the )?(?:licen[cs]e|copying)(?: file)? for (?:more )?details
5 license,licence licence-file: see (?:the )?(?:accompanying |attached )?licen[cs]e file
5 license,licence,licensing licence-terms: (?:licen[cs]e|licensing) (?:terms|agreement|conditions)
5 license,licence end-user-licence: end user licen[cs]e agreement
5 eula end-user-licence: eula
5 permission permission: (?:used|reprinted|reproduced) (?:with|by) permission
5 warranty no-warranty: without warranty of any kind
5 warranty no-warranty: (?:provided )?as is without (?:any )?warranty
5 source,software open-source: (?:open source|free software) licen[cs]e
5 royalty royalty-free: royalty free
5 trademark,trademarks trademark: (?:registered )?trademarks? of
5 patent patent: patent pending
"""


@dataclass(frozen=True)
class Rule:
    """``no`` is the place in the list; ``words`` is the pattern as written."""

    no: int
    level: int
    gates: tuple[str, ...]
    label: str
    words: str

    @property
    def pattern(self) -> str:
        return numbered(self.words)


def numbered(words: str) -> str:
    """A pattern of words as one over ``' 0:first  1:second '``, with a word's own blanks.

    A blank that may be left out (``share ?alike``) may be so with the number behind it.
    """
    number = "[0-9]+:"
    inner = re.sub(r" (\?)?", lambda m: f"(?:  {number})?" if m[1] else f"  {number}", words)
    return f" {number}{inner} "


def parse(text: str = RULES_TEXT) -> list[Rule]:
    rules = []
    for no, line in enumerate(text.strip().splitlines()):
        level, gates, rest = line.split(" ", 2)
        label, words = rest.split(": ", 1)
        rules.append(Rule(no, int(level), tuple(gates.split(",")), label, words))
    return rules
