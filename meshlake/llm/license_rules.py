"""Signature rules for licence texts and notices, in order of priority.

A rule sees words in lower case, separated by single spaces: "Apache License,
Version 2.0" reads ``apache license version 2 0``. Each line of ``SIGNATURES``
has a label, the keywords that a text must contain for the pattern to be tried
(whole words, joined by ``+``), and the pattern. Earlier lines win.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    priority: int
    label: str
    keywords: tuple[str, ...]
    pattern: str


# The phrases that are always reported, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Sentences of licence texts, notices, identifiers, names; from the particular to the general.
SIGNATURES = r"""
apache-2.0 | apache+org+licenses | you may obtain a copy of the license at https? www apache org licenses license 2 0
apache-2.0 | apache+license+version | licensed under the apache license version 2 0 the license
apache-2.0 | compliance+license | you may not use this file except in compliance with the license
apache-2.0 | agreed+writing | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | governing+permissions | see the license for the specific language governing permissions and limitations under the license
apache-2.0 | reproduce+prepare+derivative | irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work
apache-2.0 | patent+license | patent license to make have made use offer to sell sell import and otherwise transfer the work
apache-2.0 | notice+text+file | if the work includes a notice text file as part of its distribution
apache-2.0 | intentionally+contribution | any contribution intentionally submitted for inclusion in the work by you to the licensor shall be under the terms and conditions of this license
apache-2.0 | boilerplate+notice | to apply the apache license to your work attach the following boilerplate notice
apache-1.1 | apache+software+foundation | this product includes software developed by the apache software foundation
apache-1.1 | endorse+promote | the names apache and apache software foundation must not be used to endorse or promote products
apache-asf | contributor+license+agreements | licensed to the apache software foundation asf under one or more contributor license agreements
mit | hereby+granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | deal+software | to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software
mit | substantial+portions | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | merchantability | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement
mit | authors+copyright+holders | in no event shall the authors or copyright holders be liable for any claim damages or other liability
mit | connection | whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software
mit-0 | mit+attribution | mit no attribution
mit-modern | written+agreement | permission is hereby granted without written agreement and without license or royalty fees to use copy modify and distribute this software
x11 | x+consortium | except as contained in this notice the name of the x consortium shall not be used in advertising
x11 | advertising | the name of the copyright holders? shall not be used in advertising or otherwise to promote the sale use or other dealings
curl | advertising | except as contained in this notice the name of a copyright holder shall not be used in advertising
isc | without+fee | permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted
isc | author+disclaims | the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness
isc | author+liable | in no event shall the author be liable for any special direct indirect or consequential damages
hpnd | documentation+purpose | permission to use copy modify and distribute this software and its documentation for any purpose
hpnd | specific+written+prior+permission | not be used in advertising or publicity pertaining to distribution of the software without specific written prior permission
bsd | source+binary+forms | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | redistributions+source+code | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | redistributions+binary | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
bsd-3 | endorse+promote | neither the name of [^\x01-\x03]{1,80}? nor the names of (?:its|their|other) contributors may be used to endorse or promote products derived from this software without specific prior written permission
bsd-3 | endorse+promote | the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission
bsd-4 | advertising+materials | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd-4 | product+includes+software | this product includes software developed by
bsd | warranties+express | this software is provided by the (?:copyright holders and contributors|regents and contributors|author) as is and any express or implied warranties
bsd | substitute+goods | procurement of substitute goods or services loss of use data or profits or business interruption
bsd | copyright+contributors | in no event shall the copyright (?:holder|owner) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
bsd-clear | express+implied+licenses | no express or implied licenses to any party s patent rights are granted by this license
bsd-patent | perpetual+worldwide | each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide non exclusive
0bsd | zero+clause | (?:bsd )?zero clause(?: bsd)?
zlib | origin+software | the origin of this software must not be misrepresented you must not claim that you wrote the original software
zlib | altered+source | altered source versions must be plainly marked as such and must not be misrepresented as being the original software
zlib | without+express | this software is provided as is without any express or implied warranty in no event will the authors be held liable
zlib | commercial+applications | permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely
libpng | png+reference+library | the png reference library is supplied as is
libtiff | sam+leffler | the names? of sam leffler and silicon graphics may not be used in any advertising
ijg | independent+jpeg+group | this software is based in part on the work of the independent jpeg group
bsl-1.0 | boost+org | (?:https? )?www boost org license 1 0 txt
bsl-1.0 | object+code+generated | unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor
bsl-1.0 | boost+software | distributed under the boost software license version 1 0
unlicense | unencumbered | this is free and unencumbered software released into the public domain
unlicense | detriment+our+heirs | we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors
unlicense | unlicense+org | (?:https? )?(?:www )?unlicense org
wtfpl | want+public | do what the (?:fuck|heck) you want to public licen[cs]e(?: version [12])?
wtfpl | just+want | you just do what the (?:fuck|heck) you want to
beerware | beer | if we meet some day and you think this stuff is worth it you can buy me a beer in return
json | good+evil | the software shall be used for good not evil
cc0-1.0 | cc0 | (?:creative commons )?cc0 1 0 universal(?: public domain dedication)?
cc0-1.0 | affirmer | affirmer hereby overtly fully permanently irrevocably and unconditionally waives abandons and surrenders
cc0-1.0 | waived+copyright | has waived all copyright and related or neighbou?ring rights to this work
cc0-1.0 | creativecommons+org+publicdomain | creativecommons org publicdomain zero 1 0
public-domain-mark | public+domain+mark | public domain mark 1 0
cc-by-nc-sa-4.0 | creativecommons+org | creativecommons org licenses by nc sa 4 0
cc-by-nc-sa-3.0 | creativecommons+org | creativecommons org licenses by nc sa 3 0
cc-by-nc-nd-4.0 | creativecommons+org | creativecommons org licenses by nc nd 4 0
cc-by-nc-nd-3.0 | creativecommons+org | creativecommons org licenses by nc nd 3 0
cc-by-sa-4.0 | creativecommons+org | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | creativecommons+org | creativecommons org licenses by sa 3 0
cc-by-nd-4.0 | creativecommons+org | creativecommons org licenses by nd 4 0
cc-by-nc-4.0 | creativecommons+org | creativecommons org licenses by nc 4 0
cc-by-4.0 | creativecommons+org | creativecommons org licenses by 4 0
cc-by-3.0 | creativecommons+org | creativecommons org licenses by 3 0
cc-by-nc-sa | attribution | attribution non ?commercial share ?alike [1-4] [05] (?:international|unported|generic)
cc-by-nc-nd | attribution | attribution non ?commercial no ?deriv(?:ative)?s [1-4] [05] (?:international|unported|generic)
cc-by-sa-4.0 | international+attribution | attribution share ?alike 4 0 international
cc-by-nc-4.0 | international+attribution | attribution non ?commercial 4 0 international
cc-by-4.0 | attribution | (?:creative commons )?attribution 4 0 international
cc-by-3.0 | attribution | (?:creative commons )?attribution 3 0 unported
cc-by-nc-sa-4.0 | cc+nc+sa | cc by nc sa 4 0
cc-by-nc-sa-3.0 | cc+nc+sa | cc by nc sa 3 0
cc-by-nc-sa-2.5 | cc+nc+sa | cc by nc sa 2 5
cc-by-nc-sa-2.0 | cc+nc+sa | cc by nc sa 2 0
cc-by-nc-nd-4.0 | cc+nc+nd | cc by nc nd 4 0
cc-by-nc-nd-3.0 | cc+nc+nd | cc by nc nd 3 0
cc-by-sa-4.0 | cc+sa | cc by sa 4 0
cc-by-sa-3.0 | cc+sa | cc by sa 3 0
cc-by-sa-2.5 | cc+sa | cc by sa 2 5
cc-by-sa-2.0 | cc+sa | cc by sa 2 0
cc-by-nd-4.0 | cc+nd | cc by nd 4 0
cc-by-nd-3.0 | cc+nd | cc by nd 3 0
cc-by-nc-4.0 | cc+nc | cc by nc 4 0
cc-by-nc-3.0 | cc+nc | cc by nc 3 0
cc-by-nc-2.5 | cc+nc | cc by nc 2 5
cc-by-nc-2.0 | cc+nc | cc by nc 2 0
cc-by-4.0 | cc | cc by 4 0
cc-by-3.0 | cc | cc by 3 0
cc-by-2.5 | cc | cc by 2 5
cc-by-2.0 | cc | cc by 2 0
cc-by-nc-sa | cc+nc+sa | cc by nc sa
cc-by-nc-nd | cc+nc+nd | cc by nc nd
cc-by-sa | cc+sa | cc by sa
cc-by-nd | cc+nd | cc by nd
cc-by-nc | cc+nc | cc by nc
cc-by-nc-sa | creative+commons | creative commons attribution non ?commercial share ?alike
cc-by-nc-nd | creative+commons | creative commons attribution non ?commercial no ?derivatives
cc-by-sa | creative+commons | creative commons attribution share ?alike
cc-by-nd | creative+commons | creative commons attribution no ?derivatives
cc-by-nc | creative+commons | creative commons attribution non ?commercial
cc-by | creative+commons+attribution | creative commons attribution
cc | creative+commons | creative commons(?: public)? licen[cs]es?
agpl-3 | network | if you modify the program your modified version must prominently offer all users interacting with it remotely through a computer network
agpl-3 | network+server | the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software
agpl-3-or-later | affero | gnu affero general public licen[cs]e (?:as published by the free software foundation )?(?:either )?version 3 (?:of the license )?or (?:at your option )?any later version
agpl-3-or-later | affero | gnu affero general public licen[cs]e v(?:ersion )?3(?: 0)? or later
agpl-3 | affero | gnu affero general public licen[cs]e (?:version |v )?3(?: 0)?
agpl-3 | agplv3 | agplv3
agpl-3-or-later | agpl+later | agpl 3 0 or later
agpl-3-only | agpl | agpl 3 0 only
agpl-3 | agpl | agpl 3 0
agpl-1 | affero | affero general public licen[cs]e version 1
agpl | affero | (?:gnu )?affero general public licen[cs]e
agpl | agpl | (?:gnu )?agpl
lgpl-2.1-or-later | lesser+general+public | gnu lesser general public licen[cs]e as published by the free software foundation either version 2 1 of the license or at your option any later version
lgpl-3-or-later | lesser+general+public | gnu lesser general public licen[cs]e as published by the free software foundation either version 3 of the license or at your option any later version
lgpl-2-or-later | library+general+public | gnu library general public licen[cs]e as published by the free software foundation either version 2 of the license or at your option any later version
lgpl-2.1-or-later | lesser+general+public | gnu lesser general public licen[cs]e (?:version |v )?2 1 or (?:any )?later
lgpl-3-or-later | lesser+general+public | gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)? or (?:any )?later
lgpl-2.1 | lesser+general+public | gnu lesser general public licen[cs]e (?:version |v )?2 1
lgpl-3 | lesser+general+public | gnu lesser general public licen[cs]e (?:version |v )?3(?: 0)?
lgpl-2 | library+general+public | gnu library general public licen[cs]e (?:version |v )?2(?: 0)?
lgpl | library | a program that contains no derivative of any portion of the library but is designed to work with the library
lgpl | combined | you may convey a combined work under terms of your choice
lgpl-2.1-or-later | lgpl+later | lgpl 2 1 or later
lgpl-2.1-only | lgpl | lgpl 2 1 only
lgpl-3-or-later | lgpl+later | lgpl 3 0 or later
lgpl-3-only | lgpl | lgpl 3 0 only
lgpl-2.1 | lgplv2 | lgplv2 1
lgpl-2.1 | lgpl | lgpl 2 1
lgpl-3 | lgplv3 | lgplv3
lgpl-3 | lgpl | lgpl 3 0
lgpl | lesser+general+public | (?:gnu )?lesser general public licen[cs]e
lgpl | library+general+public | (?:gnu )?library general public licen[cs]e
lgpl | lgpl | (?:gnu )?lgpl
gfdl-1.3-or-later | documentation | gnu free documentation licen[cs]e version 1 3 or any later version
gfdl-1.2-or-later | documentation | gnu free documentation licen[cs]e version 1 2 or any later version
gfdl | invariant+sections | with no invariant sections no front cover texts and no back cover texts
gfdl-1.3 | documentation | gnu free documentation licen[cs]e (?:version )?1 3
gfdl-1.2 | documentation | gnu free documentation licen[cs]e (?:version )?1 2
gfdl-1.1 | documentation | gnu free documentation licen[cs]e (?:version )?1 1
gfdl | documentation | (?:gnu )?free documentation licen[cs]e
gfdl | gfdl | gfdl(?: 1 [123])?
gpl-classpath | classpath+exception | (?:with )?(?:the )?classpath exception(?: 2 0)?
gpl-linking | library | as a special exception the copyright holders of this library give you permission to link this library with independent modules
gcc-exception | gcc+runtime | gcc runtime library exception(?: version)?(?: 3 1)?
bison-exception | bison | as a special exception you may create a larger work that contains part or all of the bison parser skeleton
autoconf-exception | exception | (?:autoconf|configure) (?:script )?exception
gpl-2-or-later | either+version | gnu general public licen[cs]e as published by the free software foundation either version 2 of the licen[cs]e or at your option any later version
gpl-3-or-later | either+version | gnu general public licen[cs]e as published by the free software foundation either version 3 of the licen[cs]e or at your option any later version
gpl-2-only | software+foundation | gnu general public licen[cs]e version 2 as published by the free software foundation
gpl | redistribute+modify | this program is free software you can redistribute it and or modify it under the terms of
gpl | hope+useful | this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose
gpl | should+received+copy | you should have received a copy of the gnu general public licen[cs]e along with this (?:program|library|software)
gpl | temple+place | write to the free software foundation inc 59 temple place
gpl | franklin | write to the free software foundation inc 51 franklin st(?:reet)?
gpl-2 | freedom+share+change | the licenses for most software are designed to take away your freedom to share and change it
gpl-3 | practical+works | the licenses for most software and other practical works are designed to take away your freedom to share and change the works
gpl | share+change | the gnu general public license is intended to guarantee your freedom to share and change (?:free software|all versions of a program)
gpl | everyone+permitted | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
gpl | speak+software | when we speak of free software we are referring to freedom not price
gpl-2 | mere+aggregation | mere aggregation of another work not based on the program
gpl-3 | corresponding+source | the corresponding source for a work in object code form means all the source code needed to generate install
gpl-3 | technological+measure | no covered work shall be deemed part of an effective technological measure
gpl-3 | installation+information | installation information for a user product means any methods procedures authorization keys
gpl | certain+welcome | this is free software and you are welcome to redistribute it under certain conditions
gpl | absolutely+warranty | comes with absolutely no warranty
gpl-1-or-later | general+public | gnu general public licen[cs]e (?:version |v )?1(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2-or-later | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-3-or-later | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
gpl-2-only | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)? only
gpl-3-only | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)? only
gpl-1 | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?1(?: 0)?
gpl-2 | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?2(?: 0)?
gpl-3 | general+public | (?:gnu )?general public licen[cs]e (?:version |v )?3(?: 0)?
gpl-2-or-later | gpl+later | gpl 2 0 or later
gpl-3-or-later | gpl+later | gpl 3 0 or later
gpl-2-only | gpl | gpl 2 0 only
gpl-3-only | gpl | gpl 3 0 only
gpl-2 | gplv2 | gplv2
gpl-3 | gplv3 | gplv3
gpl-2 | gpl | gpl 2 0
gpl-3 | gpl | gpl 3 0
gpl-2 | gpl+v2 | gpl v2
gpl-3 | gpl+v3 | gpl v3
gpl | general+public | (?:gnu )?general public licen[cs]e
gpl | gpl | (?:gnu )?gpl
mpl-2.0 | source+code | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | mozilla+org+mpl | if a copy of the mpl was not distributed with this file you can obtain one at https? (?:www )?mozilla org mpl 2 0
mpl-2.0 | secondary+licenses | this source code form is incompatible with secondary licenses as defined by the mozilla public license v 2 0
mpl-1.1 | contents+file | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | contents+file | the contents of this file are subject to the mozilla public license version 1 0
mpl-tri | alternatively+contents | alternatively the contents of this file may be used under the terms of either the gnu general public license
mpl-2.0 | mozilla+public | mozilla public licen[cs]e (?:version |v )?2(?: 0)?
mpl-1.1 | mozilla+public | mozilla public licen[cs]e (?:version |v )?1 1
mpl-1.0 | mozilla+public | mozilla public licen[cs]e (?:version |v )?1 0
mpl | mozilla+public | mozilla public licen[cs]e
mpl-2.0 | mpl | mpl 2 0
mpl-1.1 | mpl | mpl 1 1
npl | netscape+public | netscape public licen[cs]e(?: version 1 [01])?
epl-2.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v |version )?2 0
epl-1.0 | eclipse | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | eclipse+public | eclipse public licen[cs]e (?:version |v )?2(?: 0)?
epl-1.0 | eclipse+public | eclipse public licen[cs]e (?:version |v )?v?1(?: 0)?
epl | eclipse+public | eclipse public licen[cs]e
edl-1.0 | eclipse+distribution | eclipse distribution licen[cs]e(?: v)?(?: 1 0)?
epl-2.0 | epl | epl 2 0
epl-1.0 | epl | epl 1 0
cddl-1.1 | common+development | common development and distribution licen[cs]e (?:cddl )?(?:version )?1 1
cddl-1.0 | common+development | common development and distribution licen[cs]e (?:cddl )?(?:version )?1 0
cddl | contents+file | the contents of this file are subject to the terms of the common development and distribution licen[cs]e
cddl | common+development | common development and distribution licen[cs]e
cddl-1.1 | cddl | cddl 1 1
cddl-1.0 | cddl | cddl 1 0
cddl | cddl | cddl
cpl-1.0 | common+public | common public licen[cs]e (?:version )?1 0
cpl | common+public | common public licen[cs]e
cpal-1.0 | common+public+attribution | common public attribution licen[cs]e(?: version)?(?: 1 0)?
eupl-1.2 | eupl+version | licen[cs]ed under the eupl version 1 2
eupl-1.2 | european+union+public | european union public licen[cs]e (?:eupl )?(?:version |v )?1 2
eupl-1.1 | european+union+public | european union public licen[cs]e (?:eupl )?(?:version |v )?1 1
eupl-1.0 | european+union+public | european union public licen[cs]e (?:eupl )?(?:version |v )?1 0
eupl | european+union+public | european union public licen[cs]e
eupl | eupl | eupl(?: (?:version |v )?1 [012])?
artistic-2.0 | artistic | artistic licen[cs]e (?:version )?2 0
artistic-1.0 | artistic | artistic licen[cs]e (?:version )?1 0
artistic | artistic+control | the copyright holder maintains some semblance of artistic control over the development of the package
artistic | standard+version | you may make and give away verbatim copies of the source form of the standard version of this package
artistic | clarified+artistic | clarified artistic licen[cs]e
artistic | artistic | artistic licen[cs]e
perl | same+terms+perl | (?:free software )?you can redistribute it and or modify it under the same terms as perl itself
afl-3.0 | academic | academic free licen[cs]e (?:version |v )?3 0
afl-2.1 | academic | academic free licen[cs]e (?:version |v )?2 1
afl-2.0 | academic | academic free licen[cs]e (?:version |v )?2 0
afl | academic | academic free licen[cs]e
osl-3.0 | open+software+license | open software license (?:version |v )?3 0
osl-2.1 | open+software+license | open software license (?:version |v )?2 1
osl | open+software+license | open software license
ecl-2.0 | educational+community | educational community licen[cs]e (?:version )?2 0
ecl | educational+community | educational community licen[cs]e
busl-1.1 | business+source | business source licen[cs]e (?:version )?1 1
busl-1.1 | change+date | effective on the change date or the fourth anniversary of the first publicly available distribution
busl-1.1 | non+production | the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use of the licensed work
busl-1.1 | additional+grant | additional use grant
busl | business+source | business source licen[cs]e
sspl-1 | server+side+public | server side public licen[cs]e (?:version |v )?1
sspl-1 | service | offering the program as a service includes without limitation enabling third parties to interact with the functionality of the program
sspl | server+side+public | server side public licen[cs]e
elastic-2.0 | elastic | elastic licen[cs]e (?:version |v )?2(?: 0)?
elastic-2.0 | hosted+managed+service | you may not provide the software to third parties as a hosted or managed service
elastic | elastic | elastic licen[cs]e
commons-clause | commons+clause | commons clause(?: license condition)?(?: v1 0)?
polyform-nc | polyform | polyform noncommercial licen[cs]e(?: 1 0 0)?
polyform-sb | polyform | polyform small business licen[cs]e(?: 1 0 0)?
polyform | polyform | polyform [a-z]+ licen[cs]e
confluent | confluent+community | confluent community licen[cs]e(?: agreement)?(?: version 1 0)?
timescale | timescale | timescale licen[cs]e(?: agreement)?
rsal | redis+source+available | redis source available licen[cs]e(?: agreement)?
parity | parity+public | parity public licen[cs]e(?: [67] 0 0)?
prosperity | prosperity+public | prosperity public licen[cs]e(?: [23] 0 0)?
hippocratic | hippocratic | hippocratic licen[cs]e(?: 2 1)?
ofl-1.1 | open+font | this font software is licensed under the sil open font license version 1 1
ofl-1.1 | reserved+font | no modified version of the font software may use the reserved font names? unless explicit written permission is granted
ofl-1.1 | font+software | neither the font software nor any of its individual components in original or modified versions may be sold by itself
ofl-1.1 | open+font | (?:sil )?open font licen[cs]e (?:version )?1 1
ofl-1.0 | open+font | (?:sil )?open font licen[cs]e (?:version )?1 0
ofl | open+font | (?:sil )?open font licen[cs]e
ubuntu-font | ubuntu+font | ubuntu font licen[cs]e(?: version)?(?: 1 0)?
bitstream-vera | bitstream+vera | bitstream vera(?: fonts)? copyright
gust-font | gust+font | gust font licen[cs]e
lppl-1.3c | latex+project+public | latex project public licen[cs]e (?:version )?1 3c?
lppl | latex+project+public | latex project public licen[cs]e
lppl | maintenance+status | this work has the lppl maintenance status (?:maintained|author maintained|unmaintained)
apsl-2.0 | apple+public+source | apple public source licen[cs]e (?:version )?2 0
apsl | apple+public+source | apple public source licen[cs]e
ms-pl | microsoft+public | microsoft public licen[cs]e(?: ms pl)?
ms-rl | microsoft+reciprocal | microsoft reciprocal licen[cs]e(?: ms rl)?
ms-lpl | microsoft+limited+public | microsoft limited public licen[cs]e
php-3.01 | php | (?:the )?php licen[cs]e (?:version )?3 01
php-3.0 | php | (?:the )?php licen[cs]e (?:version )?3 0
php | php | php licen[cs]e
php | includes+php | this product includes php software freely available from
psf-2 | python+software+foundation | python software foundation licen[cs]e version 2
psf | nonexclusive+licensee | psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce analyze test perform
psf | python+software+foundation | python software foundation licen[cs]e
cnri | cnri | cnri (?:open source )?licen[cs]e(?: agreement)?
zpl-2.1 | zope+public | zope public licen[cs]e (?:zpl )?(?:version )?2 1
zpl-2.0 | zope+public | zope public licen[cs]e (?:zpl )?(?:version )?2 0
zpl | zope+public | zope public licen[cs]e
qpl-1.0 | q+public | q public licen[cs]e(?: version)?(?: 1 0)?
ipl-1.0 | ibm+public | ibm public licen[cs]e(?: version)?(?: 1 0)?
sissl | sun+industry+standards | sun industry standards source licen[cs]e
bcl | binary+code | (?:sun microsystems inc |oracle )?binary code licen[cs]e agreement
otn | oracle+technology+network | oracle technology network(?: developer)? licen[cs]e(?: agreement)?
upl-1.0 | universal+permissive | universal permissive licen[cs]e(?: upl)?(?: version)?(?: 1 0)?
ncsa | illinois | university of illinois (?:ncsa )?open source licen[cs]e
llvm-exception | llvm | (?:with )?llvm exceptions?
w3c | w3c | w3c software (?:notice and )?(?:and document )?(?:notice and )?licen[cs]e
ogc | open+geospatial | open geospatial consortium inc licen[cs]e
postgresql | postgresql | postgresql licen[cs]e
postgresql | university+california | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
openssl | openssl | this product includes software developed by the openssl project for use in the openssl toolkit
openssl | openssl | openssl licen[cs]e
ssleay | eric+young | this product includes cryptographic software written by eric young
ruby | ruby | ruby licen[cs]e
ruby | same+terms+ruby | under the same terms as ruby
vim | vim | vim licen[cs]e
tcl | tcl | tcl tk licen[cs]e
info-zip | info+zip | info zip licen[cs]e
bzip2 | bzip2 | bzip2(?: and libbzip2)? licen[cs]e
icu | unicode+inc | unicode inc licen[cs]e agreement data files and software
unicode | data+files | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
ftl | freetype | freetype (?:project )?licen[cs]e
naist | naist | naist(?: 2003)? licen[cs]e
sleepycat | sleepycat | (?:the )?sleepycat licen[cs]e
watcom | sybase+open+watcom | sybase open watcom public licen[cs]e
intel | intel+open+source | intel open source licen[cs]e
nvidia-eula | nvidia | nvidia (?:software|cuda toolkit|deep learning) (?:end user )?licen[cs]e(?: agreement)?
imagemagick | imagemagick | imagemagick licen[cs]e
stlport | stlport | stlport licen[cs]e
dom4j | dom4j | dom4j licen[cs]e
jdom | jdom | jdom licen[cs]e
xfree86 | xfree86 | xfree86 licen[cs]e(?: 1 [01])?
cecill-2.1 | cecill | cecill (?:free software )?licen[cs]e(?: agreement)?(?: version| v)? ?2 1
cecill-b | cecill+b | cecill b
cecill-c | cecill | cecill c
cecill | cecill | cecill
mulan-2 | mulan | mulan (?:psl|permissive software licen[cs]e)(?: v2| version 2)
mulan | mulan | mulan (?:psl|permissive software licen[cs]e)
cern-ohl | cern+open+hardware | cern open hardware licen[cs]e(?: version| v)?(?: [12](?: [0-2])?)?
tapr-ohl | tapr+open+hardware | tapr open hardware licen[cs]e
solderpad | solderpad | solderpad hardware licen[cs]e
odbl-1.0 | open+database | open database licen[cs]e(?: odbl)?(?: v)?(?: 1 0)?
odbl-1.0 | openstreetmap | (?:c )?openstreetmap contributors
odc-by-1.0 | open+data+commons | open data commons attribution licen[cs]e(?: v)?(?: 1 0)?
pddl-1.0 | open+data+commons | open data commons public domain dedication and licen[cs]e
dbcl | database+contents | database contents licen[cs]e(?: dbcl)?
cdla-permissive | community+data | community data licen[cs]e agreement permissive(?: version)?(?: [12] 0)?
cdla-sharing | community+data | community data licen[cs]e agreement sharing(?: version)?(?: 1 0)?
ogl-uk-3 | open+government | open government licen[cs]e (?:version |v )?v?3(?: 0)?
ogl | open+government | open government licen[cs]e
etalab | etalab | (?:licence ouverte|open licen[cs]e)(?: version)?(?: [12] 0)? etalab
dl-de-by | datenlizenz | datenlizenz deutschland namensnennung(?: version)?(?: 2 0)?
openrail-m | openrail | (?:creativeml |bigscience |bigcode )?openrail(?: [ms])?(?: licen[cs]e)?
rail | responsible+ai | responsible ai licen[cs]es?
llama | llama | llama [23](?: [123])? community licen[cs]e(?: agreement)?
gemma | gemma+terms | gemma terms of use
free-art | art | free art licen[cs]e(?: 1 [23])?
dsl | design+science | design science licen[cs]e
opl | open+publication | open publication licen[cs]e(?: v)?(?: 1 0)?
oca | open+content | open content licen[cs]e
gutenberg | project+gutenberg | project gutenberg(?: tm)? licen[cs]e
gutenberg | project+gutenberg | this e ?book is for the use of anyone anywhere (?:in the united states and most other parts of the world )?at no cost and with almost no restrictions whatsoever [^\x01-\x03]{0,120}? project gutenberg
bsd-2 | bsd+clause | bsd 2 clause(?: simplified| freebsd)?(?: licen[cs]e)?
bsd-3 | bsd+clause | bsd 3 clause(?: new or revised| new| revised)?(?: licen[cs]e)?
bsd-4 | bsd+clause | bsd 4 clause(?: original)?(?: licen[cs]e)?
bsd-2 | simplified+bsd | simplified bsd(?: licen[cs]e)?
bsd-3 | bsd | (?:new|modified|revised) bsd licen[cs]e
bsd-2 | freebsd | freebsd licen[cs]e
bsd | bsd+style | bsd style licen[cs]e
bsd | bsd | bsd licen[cs]e
mit | license+identifier+mit | spdx license identifier mit
isc | license+identifier+isc | spdx license identifier isc
spdx | spdx+license+identifier | spdx license identifier
mit | mit | (?:the )?mit licen[cs]e
mit | mit+style | mit style licen[cs]e
mit | expat | expat licen[cs]e
isc | isc | isc licen[cs]e
x11 | x11 | x11 licen[cs]e
zlib | zlib | zlib(?: libpng)? licen[cs]e
bsl-1.0 | boost+software | boost software licen[cs]e(?: version)?(?: 1 0)?
unlicense | unlicense | unlicense
beerware | beerware | (?:the )?beerware(?: licen[cs]e)?
apache-2.0 | apache | apache licen[cs]e (?:version |v )?v?2(?: 0)?
apache-1.1 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 1
apache-1.0 | apache | apache (?:software )?licen[cs]e (?:version |v )?1 0
apache-2.0 | apache+software | apache software licen[cs]e (?:version |v )?v?2(?: 0)?
apache-2.0 | apache | apache 2 0
apache | apache | apache (?:software )?licen[cs]e
cc0 | cc0 | cc0
eula | user | end user licen[cs]e agreement
eula | terms | by (?:installing|downloading|using|clicking) [^\x01-\x03]{0,80}? you (?:agree to be bound by|accept|agree to) the terms of this (?:agreement|eula|license)
eula | reverse+engineer | (?:you )?(?:may|shall|will|must) not (?:copy modify )?(?:decompile )?(?:disassemble )?(?:or )?reverse engineer
eula | licensed+sold | (?:the )?software is licensed not sold
eula | non+transferable | (?:limited )?non exclusive non transferable (?:revocable )?licen[cs]e
terms | terms+service | (?:agree to|subject to|accept) (?:the |our |these )?terms of service
terms | terms | (?:agree to|subject to|accept) (?:the |our |these )?terms of use
trademark | registered | (?:are|is) (?:a )?registered trademarks? of
trademark | respective+trademarks | all (?:other )?trademarks are the property of their respective owners
warranty | without | (?:the software |this software )?is provided as is without (?:any )?warrant(?:y|ies) of any kind
warranty | fitness+particular | warranties of merchantability and fitness for a particular purpose
warranty | consequential+damages | (?:direct )?indirect incidental special (?:exemplary )?(?:or|and) consequential damages
permission | permission | (?:reprinted|reproduced|used|published) (?:here )?with (?:the )?(?:kind )?permission
permission | prior+written | without the (?:express )?prior written (?:permission|consent)
permission | part+may | no part of this (?:publication|book|work|document|website|site) may be (?:reproduced|copied|used|distributed|stored)
permission | transmitted | (?:reproduced |stored in a retrieval system )?or transmitted in any form or by any means
non-commercial | only+use | (?:for )?(?:personal and )?non ?commercial use only
non-commercial | commercial+purposes | not (?:be used )?for commercial purposes
educational | only+for | for (?:educational|academic|research) (?:and (?:educational|academic|research) )?(?:use|purposes) only
internal | internal | (?:for )?internal use only
proprietary | confidential | (?:proprietary and confidential|confidential and proprietary)
proprietary | trade | (?:contains |constitutes )?(?:valuable )?trade secrets?
proprietary | prohibited | unauthori[sz]ed (?:copying|reproduction|distribution|use) (?:of this (?:file|document|software) )?(?:via any medium )?is (?:strictly )?prohibited
restricted-rights | restricted+rights | (?:u s )?government (?:users )?restricted rights
restricted-rights | commercial+computer+software | commercial computer software (?:and commercial computer software )?documentation
public-domain | public+domain | (?:has been |is )?(?:released|dedicated|placed)(?: in| into| to) the public domain
public-domain | public+domain | (?:is )?in the public domain
public-domain | public+domain | public domain
copyleft | copyleft | copyleft
open-source | open+source | open source licen[cs]es?
dual | dual | dual licen[cs](?:ed|ing|e)
royalty-free | royalty | royalty free(?: licen[cs]e)?
license-file | see+for | see the (?:accompanying )?(?:file )?licen[cs]e(?: file| txt| md)? for (?:more |further )?(?:details|information|terms)
license-file | full+for | for the full licen[cs]e (?:text )?(?:please )?(?:see|view|read)
copyright | copyright+notice | (?:retain|reproduce|include) (?:the above |this )?copyright notice
copyright | copyright | copyright(?: c)? (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])*
copyright | reserved+rights | c (?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])* all rights reserved
copyright | copyrighted | (?:this |the )?(?:work|material|content|text) is copyrighted
copyright | copyright | copyright
reserved | rights+reserved | (?:all|some|no) rights reserved
licensed | under | (?:licen[cs]ed|released|distributed|available) under (?:the )?(?:terms of )?(?:the )?(?:[a-z0-9]+ ){1,4}licen[cs]e
"""



def rules_of(lines: str) -> list[Rule]:
    split = [line.split(" | ") for line in lines.strip().splitlines()]
    return [Rule(k, label, tuple(keywords.split("+")), pattern) for k, (label, keywords, pattern) in enumerate(split)]


RULES = rules_of(SIGNATURES)
