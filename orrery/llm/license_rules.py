"""The signature rules of the license scan, by hand: ``priority | label | keyword | regex`` in each line.

A rule looks at words: lower-case runs of letters and digits, each a word, a space between two of them; punctuation is gone, so
``BSD-3-Clause`` reads ``bsd 3 clause``. A space in a regex stands between two words, and a match begins and ends with whole
words. The keyword is a word that every match holds. Of priorities the smallest goes first: 1 tags and addresses, 2 names with
versions, 3 sentences of the license texts and notices, 4 names alone, 5 hints. Regexes use only what Java and RE2 share.
"""

RULES = r"""
1 | mit | spdx | spdx license identifier mit
1 | mit-0 | spdx | spdx license identifier mit 0
1 | apache-2 | spdx | spdx license identifier apache 2 0
1 | apache-1.1 | spdx | spdx license identifier apache 1 1
1 | bsd-3-clause | spdx | spdx license identifier bsd 3 clause
1 | bsd-2-clause | spdx | spdx license identifier bsd 2 clause
1 | bsd-4-clause | spdx | spdx license identifier bsd 4 clause
1 | 0bsd | spdx | spdx license identifier 0bsd
1 | isc | spdx | spdx license identifier isc
1 | zlib | spdx | spdx license identifier zlib
1 | gpl-2-only | spdx | spdx license identifier gpl 2 0(?: only)?
1 | gpl-2-or-later | spdx | spdx license identifier gpl 2 0 or later
1 | gpl-3-only | spdx | spdx license identifier gpl 3 0(?: only)?
1 | gpl-3-or-later | spdx | spdx license identifier gpl 3 0 or later
1 | lgpl-2.1-only | spdx | spdx license identifier lgpl 2 1(?: only)?
1 | lgpl-2.1-or-later | spdx | spdx license identifier lgpl 2 1 or later
1 | lgpl-3-only | spdx | spdx license identifier lgpl 3 0(?: only)?
1 | lgpl-3-or-later | spdx | spdx license identifier lgpl 3 0 or later
1 | agpl-3-only | spdx | spdx license identifier agpl 3 0(?: only)?
1 | agpl-3-or-later | spdx | spdx license identifier agpl 3 0 or later
1 | mpl-2 | spdx | spdx license identifier mpl 2 0
1 | mpl-1.1 | spdx | spdx license identifier mpl 1 1
1 | epl-1 | spdx | spdx license identifier epl 1 0
1 | epl-2 | spdx | spdx license identifier epl 2 0
1 | cddl-1 | spdx | spdx license identifier cddl 1 [01]
1 | eupl-1.2 | spdx | spdx license identifier eupl 1 2
1 | bsl-1 | spdx | spdx license identifier bsl 1 0
1 | busl-1.1 | spdx | spdx license identifier busl 1 1
1 | cc0-1 | spdx | spdx license identifier cc0 1 0
1 | cc-by | spdx | spdx license identifier cc by [1-4] [05]
1 | cc-by-sa | spdx | spdx license identifier cc by sa [1-4] [05]
1 | cc-by-nc | spdx | spdx license identifier cc by nc [1-4] [05]
1 | cc-by-nd | spdx | spdx license identifier cc by nd [1-4] [05]
1 | cc-by-nc-sa | spdx | spdx license identifier cc by nc sa [1-4] [05]
1 | cc-by-nc-nd | spdx | spdx license identifier cc by nc nd [1-4] [05]
1 | unlicense | spdx | spdx license identifier unlicense
1 | wtfpl | spdx | spdx license identifier wtfpl
1 | artistic-2 | spdx | spdx license identifier artistic 2 0
1 | psf-2 | spdx | spdx license identifier (?:psf|python) 2 0
1 | ofl-1.1 | spdx | spdx license identifier ofl 1 1
1 | ecl-2 | spdx | spdx license identifier ecl 2 0
1 | ms-pl | spdx | spdx license identifier ms pl
1 | ms-rl | spdx | spdx license identifier ms rl
1 | sspl-1 | spdx | spdx license identifier sspl 1 0
1 | mulan-psl-2 | spdx | spdx license identifier mulanpsl 2 0
1 | gfdl | spdx | spdx license identifier gfdl 1 [123](?: or later| only)?
1 | mit | opensource | opensource org licen[sc]es? mit(?: license)?
1 | bsd-3-clause | opensource | opensource org licen[sc]es? bsd 3 clause
1 | bsd-2-clause | opensource | opensource org licen[sc]es? bsd 2 clause
1 | isc | opensource | opensource org licen[sc]es? isc(?: license)?
1 | zlib | opensource | opensource org licen[sc]es? zlib(?: license)?
1 | artistic-2 | opensource | opensource org licen[sc]es? artistic (?:license )?2 0
1 | afl-3 | opensource | opensource org licen[sc]es? afl 3 0
1 | osl-3 | opensource | opensource org licen[sc]es? osl 3 0
1 | apache-2 | apache | apache org licen[sc]es license 2 0(?: txt| html)?
1 | apache-1.1 | apache | apache org licen[sc]es license 1 1(?: txt)?
1 | gpl-2 | gnu | gnu org licen[sc]es (?:old licenses )?gpl 2 0(?: txt| html)?
1 | gpl-3 | gnu | gnu org licen[sc]es gpl 3 0(?: txt| html)?
1 | lgpl-2.1 | gnu | gnu org licen[sc]es (?:old licenses )?lgpl 2 1(?: txt| html)?
1 | lgpl-3 | gnu | gnu org licen[sc]es lgpl 3 0(?: txt| html)?
1 | agpl-3 | gnu | gnu org licen[sc]es agpl 3 0(?: txt| html)?
1 | gfdl | gnu | gnu org licen[sc]es (?:old licenses )?fdl(?: 1 [123])?(?: txt| html)?
1 | mpl-2 | mozilla | mozilla org mpl 2 0
1 | mpl-1.1 | mozilla | mozilla org mpl 1 1
1 | epl-2 | eclipse | eclipse org legal epl (?:v20|2 0)(?: html)?
1 | epl-1 | eclipse | eclipse org legal epl v10(?: html)?
1 | bsl-1 | boost | boost org license 1 0(?: txt)?
1 | cc0-1 | creativecommons | creativecommons org publicdomain zero 1 0
1 | public-domain | creativecommons | creativecommons org publicdomain mark 1 0
1 | cc-by | creativecommons | creativecommons org licen[sc]es by [1-4] [05]
1 | cc-by-sa | creativecommons | creativecommons org licen[sc]es by sa [1-4] [05]
1 | cc-by-nc | creativecommons | creativecommons org licen[sc]es by nc [1-4] [05]
1 | cc-by-nd | creativecommons | creativecommons org licen[sc]es by nd [1-4] [05]
1 | cc-by-nc-sa | creativecommons | creativecommons org licen[sc]es by nc sa [1-4] [05]
1 | cc-by-nc-nd | creativecommons | creativecommons org licen[sc]es by nc nd [1-4] [05]
1 | unlicense | unlicense | unlicense org
1 | wtfpl | wtfpl | (?:www )?wtfpl net(?: txt copying)?
1 | ofl-1.1 | ofl | scripts sil org ofl
1 | odbl-1 | opendatacommons | opendatacommons org licen[sc]es odbl(?: 1 0)?
1 | odc-by-1 | opendatacommons | opendatacommons org licen[sc]es by(?: 1 0)?
1 | pddl-1 | opendatacommons | opendatacommons org licen[sc]es pddl(?: 1 0)?
1 | ogl-uk-3 | nationalarchives | nationalarchives gov uk doc open government licen[cs]e version 3
1 | eupl-1.2 | eupl | joinup ec europa eu (?:software page|collection) eupl(?: eupl text eupl 1 2)?
2 | apache-2 | apache | apache (?:software )?licen[sc]e (?:version |v )?v?2(?: 0)?
2 | apache-2 | apache | apache v?2(?: 0)?(?: licen[sc]ed?)?
2 | apache-2 | asl | asl (?:version )?2(?: 0)?
2 | apache-1.1 | apache | apache (?:software )?licen[sc]e (?:version )?v?1 1
2 | apache-1 | apache | apache (?:software )?licen[sc]e (?:version )?v?1 0
2 | gpl-2 | gpl | (?:gnu )?gpl (?:version )?v?2(?: 0)?(?: only)?
2 | gpl-2 | gplv2 | (?:gnu )?gplv2(?: only)?
2 | gpl-2-or-later | gpl | (?:gnu )?gpl (?:version )?v?2(?: 0)? or (?:any )?later(?: version)?
2 | gpl-2-or-later | gplv2 | gplv2 or (?:any )?later(?: version)?
2 | gpl-3 | gpl | (?:gnu )?gpl (?:version )?v?3(?: 0)?(?: only)?
2 | gpl-3 | gplv3 | (?:gnu )?gplv3(?: only)?
2 | gpl-3-or-later | gpl | (?:gnu )?gpl (?:version )?v?3(?: 0)? or (?:any )?later(?: version)?
2 | gpl-3-or-later | gplv3 | gplv3 or (?:any )?later(?: version)?
2 | gpl-2 | general | gnu general public licen[sc]e (?:version |v )?v?2(?: 0)?
2 | gpl-3 | general | gnu general public licen[sc]e (?:version |v )?v?3(?: 0)?
2 | gpl-1 | general | gnu general public licen[sc]e (?:version |v )?v?1(?: 0)?
2 | lgpl-2 | library | gnu library general public licen[sc]e (?:version )?v?2(?: 0)?
2 | lgpl-2.1 | lesser | gnu lesser general public licen[sc]e (?:version )?v?2 1
2 | lgpl-3 | lesser | gnu lesser general public licen[sc]e (?:version )?v?3(?: 0)?
2 | lgpl-2.1 | lgpl | (?:gnu )?lgpl (?:version )?v?2 1(?: only)?
2 | lgpl-3 | lgpl | (?:gnu )?lgpl (?:version )?v?3(?: 0)?(?: only)?
2 | lgpl-3 | lgplv3 | (?:gnu )?lgplv3
2 | agpl-3 | affero | gnu affero general public licen[sc]e (?:version )?v?3(?: 0)?
2 | agpl-3 | agpl | (?:gnu )?agpl (?:version )?v?3(?: 0)?
2 | agpl-3 | agplv3 | (?:gnu )?agplv3
2 | gfdl | documentation | gnu free documentation licen[sc]e (?:version )?1 [123]
2 | bsd-2-clause | bsd | (?:simplified )?bsd 2 clause(?: simplified)?(?: licen[sc]e)?
2 | bsd-3-clause | bsd | bsd 3 clause(?: new or revised)?(?: licen[sc]e)?
2 | bsd-4-clause | bsd | bsd 4 clause(?: original or old)?(?: licen[sc]e)?
2 | bsd-2-clause | clause | (?:2|two) clause bsd(?: licen[sc]e)?
2 | bsd-3-clause | clause | (?:3|three) clause bsd(?: licen[sc]e)?
2 | bsd-4-clause | clause | (?:4|four) clause bsd(?: licen[sc]e)?
2 | bsd-3-clause | bsd | (?:new|modified|revised) bsd licen[sc]e
2 | bsd-2-clause | bsd | (?:simplified|freebsd) bsd licen[sc]e
2 | bsd-4-clause | bsd | (?:original|old) bsd licen[sc]e
2 | 0bsd | bsd | (?:bsd zero clause|zero clause bsd)(?: licen[sc]e)?
2 | bsd-3-clause-clear | bsd | bsd 3 clause clear(?: licen[sc]e)?
2 | mpl-2 | mozilla | mozilla public licen[sc]e (?:version |v )?v?2(?: 0)?
2 | mpl-1.1 | mozilla | mozilla public licen[sc]e (?:version |v )?v?1 1
2 | mpl-1 | mozilla | mozilla public licen[sc]e (?:version |v )?v?1 0
2 | mpl-2 | mpl | mpl (?:version )?v?2(?: 0)?
2 | mpl-1.1 | mpl | mpl (?:version )?v?1 1
2 | epl-2 | eclipse | eclipse public licen[sc]e (?:version |v )?v?2(?: 0)?
2 | epl-1 | eclipse | eclipse public licen[sc]e (?:version |v )?v?1(?: 0)?
2 | edl-1 | eclipse | eclipse distribution licen[sc]e (?:version |v )?v?1(?: 0)?
2 | cpl-1 | common | common public licen[sc]e (?:version |v )?1 0
2 | cddl-1 | cddl | cddl (?:version )?1 [01]
2 | cddl-1 | distribution | common development and distribution licen[sc]e(?: cddl)?(?: version)? 1 [01]
2 | cpal-1 | attribution | common public attribution licen[sc]e (?:version )?1 0
2 | eupl-1.1 | european | european union public licen[sc]e (?:version |v )?v?1 1
2 | eupl-1.2 | european | european union public licen[sc]e (?:version |v )?v?1 2
2 | eupl-1.2 | eupl | eupl v?1 2
2 | bsl-1 | boost | boost software licen[sc]e (?:version )?1 0
2 | busl-1.1 | business | business source licen[sc]e (?:version )?1 1
2 | sspl-1 | server | server side public licen[sc]e (?:version |v )?v?1
2 | elastic-2 | elastic | elastic licen[sc]e (?:version )?v?2(?: 0)?
2 | artistic-2 | artistic | artistic licen[sc]e (?:version )?2 0
2 | artistic-1 | artistic | artistic licen[sc]e (?:version )?1 0
2 | psf-2 | python | python software foundation licen[sc]e version 2
2 | zpl-2.1 | zope | zope public licen[sc]e (?:zpl )?(?:version )?2 1
2 | afl-3 | academic | academic free licen[sc]e (?:version )?v?3 0
2 | osl-3 | open | open software licen[sc]e (?:version )?v?3 0
2 | ecl-2 | educational | educational community licen[sc]e (?:version )?2 0
2 | ofl-1.1 | sil | sil open font licen[sc]e (?:version )?1 1
2 | ms-pl | microsoft | microsoft public licen[sc]e(?: ms pl)?
2 | ms-rl | microsoft | microsoft reciprocal licen[sc]e(?: ms rl)?
2 | upl-1 | universal | universal permissive licen[sc]e(?: upl)? (?:version )?v?1 0
2 | mulan-psl-2 | mulan | mulan permissive software licen[sc]e (?:version )?v?2
2 | cecill-2.1 | cecill | cecill (?:version )?2 1
2 | cecill-b | cecill | cecill b(?: licen[sc]e)?
2 | cecill-c | cecill | cecill c(?: licen[sc]e)?
2 | cc-by | cc | cc by(?: [1-4] [05])?
2 | cc-by-sa | cc | cc by sa(?: [1-4] [05])?
2 | cc-by-nc | cc | cc by nc(?: [1-4] [05])?
2 | cc-by-nd | cc | cc by nd(?: [1-4] [05])?
2 | cc-by-nc-sa | cc | cc by nc sa(?: [1-4] [05])?
2 | cc-by-nc-nd | cc | cc by nc nd(?: [1-4] [05])?
2 | cc0-1 | cc0 | cc0(?: 1 0)?(?: universal)?
2 | cc-by | attribution | creative commons attribution(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-sa | creative | creative commons attribution (?:sharealike|share alike)(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nc | noncommercial | creative commons attribution noncommercial(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nc | commercial | creative commons attribution non commercial(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nd | noderivatives | creative commons attribution noderivatives(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nd | noderivs | creative commons attribution noderivs(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nc-sa | sharealike | creative commons attribution noncommercial sharealike(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nc-nd | noderivatives | creative commons attribution noncommercial noderivatives(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | cc-by-nc-nd | noderivs | creative commons attribution noncommercial noderivs(?: licen[sc]e)?(?: [1-4] [05])?(?: international| unported| generic)?
2 | odbl-1 | database | open (?:data commons open )?database licen[sc]e(?: odbl)?(?: v?1 0)?
2 | odc-by-1 | commons | open data commons attribution licen[sc]e(?: v?1 0)?
2 | pddl-1 | commons | open data commons public domain dedication (?:and )?licen[sc]e(?: v?1 0)?
2 | ogl-uk-3 | government | open government licen[sc]e (?:version |v )?v?3(?: 0)?
2 | cdla-permissive-2 | community | community data licen[sc]e agreement permissive (?:version )?2 0
2 | openrail-m | openrail | (?:creativeml |bigscience )?openrail m(?: licen[sc]e)?
2 | bigcode-openrail-m | bigcode | bigcode openrail m(?: v1)?
2 | ncsa | ncsa | university of illinois ncsa open source licen[sc]e
2 | w3c | w3c | w3c software (?:notice and )?licen[sc]e
2 | postgresql | postgresql | postgresql licen[sc]e
2 | openssl | openssl | openssl licen[sc]e
2 | php-3.01 | php | php licen[sc]e (?:version )?3 01
2 | php-3 | php | php licen[sc]e (?:version )?3 0
2 | ruby | ruby | ruby licen[sc]e
2 | vim | vim | vim licen[sc]e
2 | libpng | libpng | libpng licen[sc]e(?: version 2)?
2 | bzip2 | bzip2 | bzip2 licen[sc]e
2 | curl | curl | curl licen[sc]e
2 | icu | icu | icu licen[sc]e
2 | unicode-dfs | unicode | unicode licen[sc]e agreement data files and software
2 | ftl | freetype | freetype (?:project )?licen[sc]e
2 | ijg | jpeg | independent jpeg group licen[sc]e
2 | lppl-1.3c | latex | latex project public licen[sc]e (?:version )?1 3c?
2 | sleepycat | sleepycat | sleepycat licen[sc]e
2 | watcom-1 | watcom | sybase open watcom public licen[sc]e(?: version)? 1 0
2 | apsl-2 | apple | apple public source licen[sc]e (?:version )?2 0
2 | ibm-1 | ibm | ibm public licen[sc]e (?:version )?1 0
2 | intel | intel | intel open source licen[sc]e
2 | json | json | json licen[sc]e
2 | beerware | beerware | beerware licen[sc]e(?: revision 42)?
2 | beerware | beer | the beer ware licen[sc]e(?: revision 42)?
2 | hippocratic-2.1 | hippocratic | hippocratic licen[sc]e (?:version )?2 1
2 | blueoak-1 | blue | blue oak model licen[sc]e (?:version )?1 0 0
2 | polyform-nc-1 | polyform | polyform noncommercial licen[sc]e (?:version )?1 0 0
2 | polyform-sb-1 | polyform | polyform small business licen[sc]e (?:version )?1 0 0
2 | commons-clause | clause | commons clause licen[sc]e condition v?1 0
2 | nosl | netizen | netizen open source licen[sc]e
2 | nasa-1.3 | nasa | nasa open source agreement (?:version )?1 3
2 | rpl-1.5 | reciprocal | reciprocal public licen[sc]e (?:version )?1 5
2 | simpl-2 | simple | simple public licen[sc]e (?:version )?2 0
2 | etalab-2 | ouverte | (?:etalab )?licence ouverte (?:version )?2 0(?: etalab)?
2 | dl-de-by-2 | deutschland | datenlizenz deutschland namensnennung (?:version )?2 0
3 | mit | permission | permission is hereby granted free of charge to any person obtaining a copy
3 | mit | notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
3 | mit | warranty | the software is provided as is without warranty of any kind
3 | isc | permission | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
3 | isc | disclaims | the software is provided as is and the author disclaims all warranties
3 | bsd-style | redistribution | redistribution and use in source and binary forms with or without modification are permitted
3 | bsd-style | redistributions | redistributions of source code must retain the above copyright notice
3 | bsd-style | redistributions | redistributions in binary form must reproduce the above copyright notice
3 | bsd-3-clause | endorse | neither the names? of [^ ]+(?: [^ ]+){0,6} nor the names of (?:its|their|any) contributors may be used to endorse or promote products
3 | bsd-4-clause | advertising | all advertising materials mentioning features or use of this software must display
3 | apache-2 | apache | licensed under the apache licen[sc]e
3 | apache-2 | compliance | you may not use this file except in compliance with the licen[sc]e
3 | apache-2 | basis | distributed on an as is basis without warranties or conditions of any kind
3 | gpl-2-or-later | general | gnu general public licen[sc]e as published by the free software foundation either version 2 of the licen[sc]e or at your option any later version
3 | gpl-3-or-later | general | gnu general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
3 | gpl-2 | general | gnu general public licen[sc]e as published by the free software foundation version 2
3 | lgpl-2.1-or-later | lesser | gnu lesser general public licen[sc]e as published by the free software foundation either version 2 1 of the licen[sc]e or at your option any later version
3 | lgpl-3-or-later | lesser | gnu lesser general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
3 | agpl-3-or-later | affero | gnu affero general public licen[sc]e as published by the free software foundation either version 3 of the licen[sc]e or at your option any later version
3 | gpl-style | merchantability | without even the implied warranty of merchantability or fitness for a particular purpose
3 | gpl-style | along | you should have received a copy of the gnu (?:lesser |affero |library )?general public licen[sc]e along with
3 | mpl-2 | mozilla | this source code form is subject to the terms of the mozilla public licen[sc]e
3 | mpl-1.1 | mozilla | the contents of this file are subject to the mozilla public licen[sc]e version 1 1
3 | epl-2 | eclipse | made available under the terms of the eclipse public licen[sc]e
3 | cddl-1 | distribution | subject to the terms of the common development and distribution licen[sc]e
3 | zlib | arising | in no event will the authors be held liable for any damages arising from the use of this software
3 | zlib | misrepresented | the origin of this software must not be misrepresented
3 | bsl-1 | boost | distributed under the boost software licen[sc]e
3 | unlicense | unencumbered | this is free and unencumbered software released into the public domain
3 | wtfpl | verbatim | everyone is permitted to copy and distribute verbatim or modified copies of this licen[sc]e document
3 | cc0-1 | deed | the person who associated a work with this deed has dedicated the work to the public domain
3 | cc-by | attribution | (?:licensed|available|released|distributed) under (?:a |the )?creative commons attribution
3 | ofl-1.1 | font | this font software is licensed under the sil open font licen[sc]e
3 | artistic-1 | artistic | (?:under|of) the same terms as perl(?: itself)? artistic
3 | perl | perl | (?:under|of) the same terms as perl(?: itself)?
3 | public-domain | domain | (?:placed|released|dedicated) (?:in|into|to) the public domain
3 | openssl | openssl | this product includes software developed by the openssl project
3 | gfdl | documentation | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[sc]e
3 | ms-eula | microsoft | microsoft software licen[sc]e terms
3 | proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
3 | proprietary | copying | unauthori[sz]ed copying of this file via any medium is strictly prohibited
4 | mit | mit | (?:the )?mit licen[sc]e
4 | mit | mit | (?:licensed|released|distributed|available) under (?:the )?(?:terms of the )?mit(?: licen[sc]e)?
4 | mit | expat | expat licen[sc]e
4 | apache | apache | apache licen[sc]e
4 | bsd | bsd | bsd (?:style )?licen[sc]e
4 | gpl | gpl | (?:gnu )?gpl(?: licen[sc]e)?
4 | gpl | general | (?:gnu )?general public licen[sc]e
4 | lgpl | lgpl | (?:gnu )?lgpl(?: licen[sc]e)?
4 | lgpl | lesser | (?:gnu )?lesser general public licen[sc]e
4 | agpl | agpl | (?:gnu )?agpl(?: licen[sc]e)?
4 | agpl | affero | (?:gnu )?affero general public licen[sc]e
4 | gfdl | documentation | (?:gnu )?free documentation licen[sc]e
4 | mpl | mozilla | mozilla public licen[sc]e
4 | epl | eclipse | eclipse public licen[sc]e
4 | cddl | cddl | cddl(?: licen[sc]e)?
4 | eupl | eupl | eupl(?: licen[sc]e)?
4 | isc | isc | isc licen[sc]e
4 | zlib | zlib | zlib(?: libpng)? licen[sc]e
4 | artistic | artistic | artistic licen[sc]e
4 | wtfpl | wtfpl | wtfpl
4 | unlicense | unlicense | the unlicense
4 | creative-commons | creative | creative commons(?: licen[sc]e)?
4 | odbl | odbl | odbl
4 | ofl | font | open font licen[sc]e
4 | sspl | sspl | sspl
4 | public-domain | domain | public domain
4 | proprietary | proprietary | proprietary licen[sc]e
5 | copyright | rights | all rights reserved
5 | copyright | copyright | copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?
5 | copyright | copyrighted | copyrighted material
5 | license-hint | licensed | licensed under(?: the)?
5 | license-hint | license | see (?:the )?(?:accompanying )?license(?: file)? for (?:details|more information|the full license text)
5 | license-hint | license | (?:software|end user) license agreement
5 | license-hint | licensing | licensing (?:terms|information)
"""
