"""License scan by ordered signature rules.

Each rule is a regex over the lower-cased text with keywords, a label, a priority and a weight. One Aho-Corasick pass over
the text finds the keywords; only rules whose keywords occur run. Overlaps are resolved by priority, then length, then
start: a detection contained in the interval of a kept one goes, a merely overlapping one stays. SPDX expressions of several
licenses are taken apart first. Names without a version have labels of their own (apache-other).

The base rule is separate: three phrases over the text's words. Its labels always stay in the result.

Null and empty texts have no words, no labels and score 0. Repeated rows give repeated results. Other columns are left out.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lowered, plain_words, slices, utf8

#: Phrases of the base rule and their labels.
BASE = (((b"mit", b"license"), "mit"), ((b"apache", b"license"), "apache"), ((b"general", b"public", b"license"), "gpl"))

#: License families as label | keywords | regex of the name | SPDX identifier. Each match holds one of the keywords (a; b).
FAMILIES = """
mit | mit | mit(?:/x11|/expat)? | mit
mit-0 | mit | mit-0|mit no attribution | mit-0
apache-2.0 | apache | apache(?:\\s+software)?(?:\\s+license)?,?\\s*(?:version|v)?\\s*2(?:\\.0)? | apache-2\\.0
apache-1.1 | apache | apache(?:\\s+software)?(?:\\s+license)?,?\\s*(?:version|v)?\\s*1\\.1 | apache-1\\.1
gpl-2.0 | general public | gnu\\s+general\\s+public\\s+license,?\\s*(?:version|v)\\s*2(?:\\.0)? | gpl-2\\.0(?:-only|-or-later|\\+)?
gpl-3.0 | general public | gnu\\s+general\\s+public\\s+license,?\\s*(?:version|v)\\s*3(?:\\.0)? | gpl-3\\.0(?:-only|-or-later|\\+)?
gpl-2.0 | gpl | (?:gnu\\s+)?gpl\\s*(?:version|v)?\\s*-?2(?:\\.0)? | gpl-2\\.0(?:-only|-or-later|\\+)?
gpl-3.0 | gpl | (?:gnu\\s+)?gpl\\s*(?:version|v)?\\s*-?3(?:\\.0)? | gpl-3\\.0(?:-only|-or-later|\\+)?
lgpl-2.1 | lesser general | gnu\\s+lesser\\s+general\\s+public\\s+license,?\\s*(?:version|v)\\s*2\\.1 | lgpl-2\\.1(?:-only|-or-later|\\+)?
lgpl-3.0 | lesser general | gnu\\s+lesser\\s+general\\s+public\\s+license,?\\s*(?:version|v)\\s*3(?:\\.0)? | lgpl-3\\.0(?:-only|-or-later|\\+)?
lgpl-2.0 | library general | gnu\\s+library\\s+general\\s+public\\s+license,?\\s*(?:version|v)\\s*2(?:\\.0)? | lgpl-2\\.0(?:-only|-or-later|\\+)?
agpl-3.0 | affero | (?:gnu\\s+)?affero\\s+general\\s+public\\s+license,?\\s*(?:version|v)\\s*3(?:\\.0)? | agpl-3\\.0(?:-only|-or-later|\\+)?
gfdl-1.3 | free documentation | gnu\\s+free\\s+documentation\\s+license,?\\s*(?:version|v)\\s*1\\.[0-9] | gfdl-1\\.[0-9](?:-only|-or-later)?
mpl-1.1 | mozilla | mozilla\\s+public\\s+license,?\\s*(?:version|v)\\s*1\\.1 | mpl-1\\.1
mpl-2.0 | mozilla | mozilla\\s+public\\s+license,?\\s*(?:version|v)\\.?\\s*2(?:\\.0)? | mpl-2\\.0
epl-1.0 | eclipse | eclipse\\s+public\\s+license,?\\s*(?:-\\s*)?(?:version|v)\\s*1(?:\\.0)? | epl-1\\.0
epl-2.0 | eclipse | eclipse\\s+public\\s+license,?\\s*(?:-\\s*)?(?:version|v)\\s*2(?:\\.0)? | epl-2\\.0
edl-1.0 | eclipse | eclipse\\s+distribution\\s+license,?\\s*(?:-\\s*)?(?:version|v)\\s*1(?:\\.0)? | edl-1\\.0
cddl-1.0 | development and distribution | common\\s+development\\s+and\\s+distribution\\s+license | cddl-1\\.[01]
cpl-1.0 | common public | common\\s+public\\s+license | cpl-1\\.0
bsd-2-clause | bsd | (?:simplified\\s+bsd|freebsd|(?:2|two)[- ]clause\\s+bsd|bsd[- ]2[- ]clause) | bsd-2-clause
bsd-3-clause | bsd | (?:(?:new|modified|revised)\\s+bsd|(?:3|three)[- ]clause\\s+bsd|bsd[- ]3[- ]clause) | bsd-3-clause
bsd-4-clause | bsd | (?:original\\s+bsd|(?:4|four)[- ]clause\\s+bsd|bsd[- ]4[- ]clause) | bsd-4-clause
0bsd | bsd | (?:zero[- ]clause\\s+bsd|0bsd) | 0bsd
isc | isc | isc | isc
zlib | zlib | zlib(?:/libpng)? | zlib
libpng | libpng | libpng | libpng(?:-2\\.0)?
bsl-1.0 | boost | boost\\s+software\\s+license(?:,?\\s*(?:version|v)\\s*1\\.0)? | bsl-1\\.0
busl-1.1 | business source | business\\s+source\\s+license(?:,?\\s*(?:version|v)?\\s*1\\.1)? | busl-1\\.1
sspl-1.0 | server side | server\\s+side\\s+public\\s+license | sspl-1\\.0
elastic-2.0 | elastic | elastic\\s+license(?:,?\\s*(?:version|v)?\\s*2(?:\\.0)?)? | elastic-2\\.0
artistic-1.0 | artistic | artistic\\s+license,?\\s*(?:version|v)?\\s*1(?:\\.0)? | artistic-1\\.0(?:-perl)?
artistic-2.0 | artistic | artistic\\s+license,?\\s*(?:version|v)?\\s*2(?:\\.0)? | artistic-2\\.0
afl-3.0 | academic free | academic\\s+free\\s+license | afl-[123]\\.[0-9]
osl-3.0 | open software | open\\s+software\\s+license | osl-[123]\\.[0-9]
ms-pl | microsoft public | microsoft\\s+public\\s+license | ms-pl
ms-rl | microsoft reciprocal | microsoft\\s+reciprocal\\s+license | ms-rl
unlicense | unlicense | (?:the\\s+)?unlicense | unlicense
wtfpl | wtfpl; what the fuck | (?:wtfpl|do\\s+what\\s+the\\s+fuck\\s+you\\s+want\\s+to\\s+public\\s+license) | wtfpl
python-2.0 | python software foundation | python\\s+software\\s+foundation\\s+license | (?:python|psf)-2\\.0
php-3.01 | php license | php\\s+license | php-3\\.0?1
ruby | ruby license | ruby\\s+license | ruby
openssl | openssl | openssl | openssl
ofl-1.1 | open font | (?:sil\\s+)?open\\s+font\\s+license | ofl-1\\.[01]
ubuntu-font-1.0 | ubuntu font | ubuntu\\s+font\\s+licen[cs]e | ubuntu-font-1\\.0
eupl-1.2 | european union | european\\s+union\\s+public\\s+licen[cs]e | eupl-1\\.[012]
cecill-2.1 | cecill | cecill(?:-[bc])? | cecill-(?:2\\.[01]|b|c)
ecl-2.0 | educational community | educational\\s+community\\s+license | ecl-[12]\\.0
ncsa | ncsa | (?:university\\s+of\\s+illinois/)?ncsa(?:\\s+open\\s+source)? | ncsa
postgresql | postgresql license | postgresql\\s+license | postgresql
vim | vim license | vim\\s+license | vim
w3c | w3c | w3c(?:\\s+software)?(?:\\s+notice\\s+and)? | w3c
x11 | x11 license | x11\\s+license | x11
odbl-1.0 | open database | open\\s+data(?:\\s+commons\\s+open\\s+data)?base\\s+license | odbl-1\\.0
odc-by-1.0 | open data commons | open\\s+data\\s+commons\\s+attribution\\s+license | odc-by-1\\.0
pddl-1.0 | public domain dedication | (?:odc\\s+)?public\\s+domain\\s+dedication\\s+and\\s+license | pddl-1\\.0
cc0-1.0 | cc0 | (?:creative\\s+commons\\s+)?cc0(?:\\s+1\\.0)? | cc0-1\\.0
cc-by-4.0 | attribution | creative\\s+commons\\s+attribution\\s+4\\.0 | cc-by-4\\.0
cc-by-3.0 | attribution | creative\\s+commons\\s+attribution\\s+3\\.0 | cc-by-3\\.0
cc-by-sa-4.0 | alike | creative\\s+commons\\s+attribution[- ]share-?alike\\s+4\\.0 | cc-by-sa-4\\.0
cc-by-sa-3.0 | alike | creative\\s+commons\\s+attribution[- ]share-?alike\\s+3\\.0 | cc-by-sa-3\\.0
cc-by-nc-4.0 | commercial | creative\\s+commons\\s+attribution[- ]non-?commercial\\s+4\\.0 | cc-by-nc-4\\.0
cc-by-nd-4.0 | deriv | creative\\s+commons\\s+attribution[- ]no-?deriv(?:ative)?s\\s+4\\.0 | cc-by-nd-4\\.0
cc-by-nc-sa-4.0 | commercial | creative\\s+commons\\s+attribution[- ]non-?commercial[- ]share-?alike\\s+4\\.0 | cc-by-nc-sa-4\\.0
cc-by-nc-nd-4.0 | commercial | creative\\s+commons\\s+attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s\\s+4\\.0 | cc-by-nc-nd-4\\.0
llama | llama | llama\\s*[234](?:\\.[0-9])?\\s+community | llama[234](?:\\.[0-9])?
openrail | rail | (?:creativeml\\s+|bigscience\\s+|bigcode\\s+)?open\\s*rail(?:\\+\\+)?-?m? | openrail(?:\\+\\+)?
lgpl-2.1 | lgpl | (?:gnu\\s+)?lgpl,?\\s*(?:version|v)?\\s*-?2\\.1 | lgpl-2\\.1(?:-only|-or-later|\\+)?
lgpl-3.0 | lgpl | (?:gnu\\s+)?lgpl,?\\s*(?:version|v)?\\s*-?3(?:\\.0)? | lgpl-3\\.0(?:-only|-or-later|\\+)?
agpl-3.0 | agpl | (?:gnu\\s+)?agpl,?\\s*(?:version|v)?\\s*-?3(?:\\.0)? | agpl-3\\.0(?:-only|-or-later|\\+)?
mpl-2.0 | mpl | mpl[- ]?(?:version|v)?\\s*2(?:\\.0)? | mpl-2\\.0
epl-2.0 | epl | epl[- ]?(?:version|v)?\\s*2(?:\\.0)? | epl-2\\.0
bsd-other | bsd | (?:berkeley\\s+)?bsd(?:[- ]style)? | bsd
cc-by-4.0 | cc | cc[- ]by[- ]4\\.0 | cc-by-4\\.0
cc-by-3.0 | cc | cc[- ]by[- ]3\\.0 | cc-by-3\\.0
cc-by-sa-4.0 | cc | cc[- ]by[- ]sa[- ]4\\.0 | cc-by-sa-4\\.0
cc-by-sa-3.0 | cc | cc[- ]by[- ]sa[- ]3\\.0 | cc-by-sa-3\\.0
cc-by-nc-4.0 | cc | cc[- ]by[- ]nc[- ]4\\.0 | cc-by-nc-4\\.0
cc-by-nd-4.0 | cc | cc[- ]by[- ]nd[- ]4\\.0 | cc-by-nd-4\\.0
cc-by-nc-sa-4.0 | cc | cc[- ]by[- ]nc[- ]sa[- ]4\\.0 | cc-by-nc-sa-4\\.0
cc-by-nc-nd-4.0 | cc | cc[- ]by[- ]nc[- ]nd[- ]4\\.0 | cc-by-nc-nd-4\\.0
aal | attribution assurance | attribution\\s+assurance\\s+licen[cs]e | aal
aladdin | aladdin | aladdin\\s+free\\s+public\\s+licen[cs]e | aladdin
apl-1.0 | adaptive public | adaptive\\s+public\\s+licen[cs]e | apl-1\\.0
apsl-2.0 | apple public source | apple\\s+public\\s+source\\s+licen[cs]e | apsl-[12]\\.[0-2]
beerware | beer | beer-?ware | beerware
bittorrent-1.1 | bittorrent | bittorrent\\s+open\\s+source\\s+licen[cs]e | bittorrent-1\\.[01]
blueoak-1.0.0 | blue oak | blue\\s+oak\\s+model\\s+licen[cs]e | blueoak-1\\.0\\.0
bzip2-1.0.6 | bzip2 | bzip2 | bzip2-1\\.0\\.[56]
cpal-1.0 | common public attribution | common\\s+public\\s+attribution\\s+licen[cs]e | cpal-1\\.0
cpol-1.02 | code project | code\\s+project\\s+open\\s+licen[cs]e | cpol-1\\.02
cua-opl-1.0 | cua office | cua\\s+office\\s+public\\s+licen[cs]e | cua-opl-1\\.0
curl | curl | curl | curl
cdla-permissive-2.0 | community data | community\\s+data\\s+licen[cs]e\\s+agreement[- ]+permissive | cdla-permissive-[12]\\.0
cdla-sharing-1.0 | community data | community\\s+data\\s+licen[cs]e\\s+agreement[- ]+sharing | cdla-sharing-1\\.0
commons-clause | commons clause | commons\\s+clause | commons-clause
confluent-community-1.0 | confluent community | confluent\\s+community\\s+licen[cs]e | confluent-community-1\\.0
dl-de-by-2.0 | datenlizenz | datenlizenz\\s+deutschland | dl-de-(?:by|zero)-2\\.0
ecos-2.0 | ecos | ecos | ecos-2\\.0
efl-2.0 | eiffel forum | eiffel\\s+forum\\s+licen[cs]e | efl-[12]\\.0
entessa | entessa | entessa\\s+public\\s+licen[cs]e | entessa
etalab-2.0 | etalab | etalab(?:\\s+open)?\\s+licen[cs]e | etalab-2\\.0
fair | fair license | fair\\s+license | fair
frameworx-1.0 | frameworx | frameworx\\s+open\\s+licen[cs]e | frameworx-1\\.0
ftl | freetype | freetype(?:\\s+project)? | ftl
gemma | gemma | gemma\\s+terms\\s+of\\s+use | gemma
gnuplot | gnuplot | gnuplot | gnuplot
hippocratic-2.1 | hippocratic | hippocratic\\s+licen[cs]e | hippocratic-2\\.1
hpnd | historical permission | historical\\s+permission\\s+notice\\s+and\\s+disclaimer | hpnd
ibm-pibs | ibm | ibm\\s+powerpc\\s+initialization | ibm-pibs
icu | icu license | icu\\s+license | icu
ijg | independent jpeg | independent\\s+jpeg\\s+group | ijg
imagemagick | imagemagick | imagemagick | imagemagick
intel | intel open source | intel\\s+open\\s+source\\s+licen[cs]e | intel
ipa | ipa font | ipa\\s+font\\s+licen[cs]e | ipa
ipl-1.0 | ibm public | ibm\\s+public\\s+licen[cs]e | ipl-1\\.0
jasper-2.0 | jasper | jasper\\s+licen[cs]e | jasper-2\\.0
apache-other | apache | apache(?:\\s+software)?(?:\\s+licen[cs]e)? | apache
gpl-other | gpl; general public | (?:gnu\\s+)?gpl|gnu\\s+general\\s+public\\s+licen[cs]e | gpl
lgpl-other | lgpl; lesser general | (?:gnu\\s+)?lgpl|gnu\\s+lesser\\s+general\\s+public\\s+licen[cs]e | lgpl
agpl-other | agpl; affero | (?:gnu\\s+)?agpl|(?:gnu\\s+)?affero\\s+general\\s+public\\s+licen[cs]e | agpl
json | json license | json\\s+license | json
lppl-1.3c | latex project | latex\\s+project\\s+public\\s+licen[cs]e | lppl-1\\.[0-3][ac]?
lpl-1.02 | lucent public | lucent\\s+public\\s+licen[cs]e | lpl-1\\.0[02]?
miros | miros | miros\\s+licen[cs]e | miros
motosoto | motosoto | motosoto\\s+open\\s+source\\s+licen[cs]e | motosoto
mulanpsl-2.0 | mulan | mulan\\s+permissive\\s+software\\s+licen[cs]e | mulanpsl-[12]\\.0
multics | multics | multics(?:\\s+software)?\\s+licen[cs]e | multics
nasa-1.3 | nasa | nasa\\s+open\\s+source\\s+agreement | nasa-1\\.3
naumen | naumen | naumen\\s+public\\s+licen[cs]e | naumen
ngpl | nethack | nethack\\s+general\\s+public\\s+licen[cs]e | ngpl
nlod-2.0 | norwegian licen | norwegian\\s+licen[cs]e\\s+for\\s+open\\s+government\\s+data | nlod-[12]\\.0
nokia | nokia | nokia\\s+open\\s+source\\s+licen[cs]e | nokia
nosl | netizen | netizen\\s+open\\s+source\\s+licen[cs]e | nosl
npl-1.1 | netscape public | netscape\\s+public\\s+licen[cs]e | npl-1\\.[01]
ntp | ntp license | ntp\\s+license | ntp
oclc-2.0 | oclc | oclc\\s+research\\s+public\\s+licen[cs]e | oclc-2\\.0
ogl-uk-3.0 | open government | open\\s+government\\s+licen[cs]e | ogl-uk-[123]\\.0
oldap-2.8 | openldap | openldap\\s+public\\s+licen[cs]e | oldap-2\\.[0-8]
opl-1.0 | open publication | open\\s+publication\\s+licen[cs]e | opl-1\\.0
parity-7.0.0 | parity | parity\\s+public\\s+licen[cs]e | parity-[67]\\.0\\.0
polyform-noncommercial-1.0.0 | polyform | polyform\\s+noncommercial(?:\\s+licen[cs]e)? | polyform-noncommercial-1\\.0\\.0
polyform-small-business-1.0.0 | polyform | polyform\\s+small\\s+business(?:\\s+licen[cs]e)? | polyform-small-business-1\\.0\\.0
prosperity-3.0.0 | prosperity | prosperity\\s+public\\s+licen[cs]e | prosperity-3\\.0\\.0
qpl-1.0 | q public | q\\s+public\\s+licen[cs]e | qpl-1\\.0
rpl-1.5 | reciprocal public | reciprocal\\s+public\\s+licen[cs]e | rpl-1\\.[15]
rpsl-1.0 | realnetworks | realnetworks\\s+public\\s+source\\s+licen[cs]e | rpsl-1\\.0
rsal-2.0 | redis source | redis\\s+source\\s+available\\s+licen[cs]e | rsalv?-?2
saxpath | saxpath | saxpath | saxpath
sendmail | sendmail | sendmail | sendmail
sgi-b-2.0 | sgi free | sgi\\s+free\\s+software\\s+licen[cs]e\\s+b | sgi-b-[12]\\.[01]
simpl-2.0 | simple public | simple\\s+public\\s+licen[cs]e | simpl-2\\.0
sissl | sun industry | sun\\s+industry\\s+standards\\s+source\\s+licen[cs]e | sissl(?:-1\\.2)?
sleepycat | sleepycat | sleepycat | sleepycat
spl-1.0 | sun public | sun\\s+public\\s+licen[cs]e | spl-1\\.0
stability-community | stability ai | stability\\s+ai\\s+community\\s+licen[cs]e | stability-community
tcl | tcl | tcl/tk | tcl
timescale | timescale | timescale\\s+licen[cs]e | timescale
upl-1.0 | universal permissive | universal\\s+permissive\\s+licen[cs]e | upl-1\\.0
vsl-1.0 | vovida | vovida\\s+software\\s+licen[cs]e | vsl-1\\.0
watcom-1.0 | watcom | sybase\\s+open\\s+watcom\\s+public\\s+licen[cs]e | watcom-1\\.0
wxwindows | wxwindows | wxwindows(?:\\s+library)? | wxwindows
xfree86-1.1 | xfree86 | xfree86 | xfree86-1\\.1
xnet | x.net | x\\.net | xnet
zed | zed license | zed\\s+license | zed
zend-2.0 | zend | zend(?:\\s+engine)? | zend-2\\.0
zimbra-1.3 | zimbra | zimbra\\s+public\\s+licen[cs]e | zimbra-1\\.[34]
zpl-2.1 | zope | zope\\s+public\\s+licen[cs]e | zpl-[12]\\.[01]
"""

#: Forms in which a family is named, as priority | weight | keywords | regex; {name} and {spdx} stand for the family's.
FORMS = """
90 | 1.0 | spdx-license-identifier | spdx-license-identifier:\\s*\\(?{spdx}(?![a-z0-9+-]|\\.[a-z0-9])
70 | 0.95 | licen | licen[cs]ed\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?{name}(?:\\s+licen[cs]e)?\\b
68 | 0.9 | ed under | (?:released|distributed|provided|published)\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?{name}(?:\\s+licen[cs]e)?\\b
67 | 0.9 | available under | available\\s+under\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?{name}(?:\\s+licen[cs]e)?\\b
60 | 0.85 | subject to; governed by; covered by; accordance with | (?:subject\\s+to|governed\\s+by|covered\\s+by|in\\s+accordance\\s+with)\\s+(?:the\\s+)?(?:terms\\s+of\\s+(?:the\\s+)?)?{name}(?:\\s+licen[cs]e)?\\b
50 | 0.8 | licen | licen[cs]e\\s*[:=]\\s*["']?(?:the\\s+)?{name}\\b
40 | 0.7 | licen | \\b{name}\\s+(?:international\\s+|unported\\s+)?(?:public\\s+)?licen[cs]e\\b
"""

#: Sentences of full license texts and notices, as label | priority | weight | keywords | regex.
NOTICES = """
mit | 100 | 1.0 | hereby granted, free of charge | permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
mit | 84 | 0.8 | the above copyright notice | the above copyright notice and this permission notice shall be included in all copies or substantial portions
bsd-3-clause | 100 | 1.0 | redistribution and use | redistribution and use in source and binary forms(?s:.{0,1500}?)neither the name
bsd-2-clause | 95 | 0.9 | redistribution and use | redistribution and use in source and binary forms, with or without modification, are permitted
bsd-4-clause | 101 | 1.0 | all advertising materials | all advertising materials mentioning features or use of this software must display
isc | 100 | 1.0 | with or without fee | permission to use, copy, modify, and(?:/or)? distribute this software for any purpose with or without fee
apache-2.0 | 100 | 1.0 | apache license | licensed under the apache license, version 2\\.0 \\(the "license"\\)
apache-2.0 | 92 | 1.0 | apache.org/licenses | apache\\.org/licenses/license-2\\.0
gpl-3.0 | 100 | 1.0 | free software | this program is free software: you can redistribute it(?s:.{0,200}?)version 3
gpl-2.0 | 100 | 1.0 | free software | this program is free software; you can redistribute it(?s:.{0,200}?)version 2
lgpl-2.1 | 100 | 1.0 | free software | this library is free software; you can redistribute it(?s:.{0,200}?)version 2\\.1
agpl-3.0 | 99 | 1.0 | affero | terms of the gnu affero general public license
gpl-other | 30 | 0.6 | gnu.org/licenses | gnu\\.org/licenses/
mpl-2.0 | 100 | 1.0 | source code form | this source code form is subject to the terms of the mozilla public license
epl-2.0 | 100 | 1.0 | eclipse public | this program and the accompanying materials are made available under the terms of the eclipse public license
unlicense | 100 | 1.0 | public domain | this is free and unencumbered software released into the public domain
public-domain | 35 | 0.7 | public domain | (?:released|dedicated|placed) (?:in)?to the public domain
zlib | 100 | 1.0 | 'as-is' | this software is provided 'as-is', without any express or implied warranty
bsl-1.0 | 100 | 1.0 | free of charge | permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software
cc-by | 45 | 0.7 | creativecommons.org | creativecommons\\.org/licenses/by/
cc-by-sa | 45 | 0.7 | creativecommons.org | creativecommons\\.org/licenses/by-sa/
cc-by-nc | 45 | 0.7 | creativecommons.org | creativecommons\\.org/licenses/by-nc/
cc-by-nd | 45 | 0.7 | creativecommons.org | creativecommons\\.org/licenses/by-nd/
cc-by-nc-sa | 45 | 0.7 | creativecommons.org | creativecommons\\.org/licenses/by-nc-sa/
cc-by-nc-nd | 45 | 0.7 | creativecommons.org | creativecommons\\.org/licenses/by-nc-nd/
cc0-1.0 | 46 | 0.8 | creativecommons.org | creativecommons\\.org/publicdomain/zero/
lgpl-3.0 | 100 | 1.0 | free software | this library is free software: you can redistribute it(?s:.{0,200}?)version 3
agpl-3.0 | 100 | 1.0 | free software | this program is free software(?s:.{0,120}?)affero general public license(?s:.{0,120}?)version 3
gfdl-1.3 | 100 | 1.0 | free documentation | permission is granted to copy, distribute and/or modify this document under the terms of the gnu free documentation license
mpl-1.1 | 100 | 1.0 | mozilla public | the contents of this file are subject to the mozilla public license version 1\\.1
npl-1.1 | 100 | 1.0 | netscape public | the contents of this file are subject to the netscape public license
cddl-1.0 | 100 | 1.0 | development and distribution | the contents of this file are subject to the terms of the common development and distribution license
apsl-2.0 | 100 | 1.0 | apple public source | this file contains original code and/or modifications of original code as defined in and that are subject to the apple public source license
artistic-1.0 | 100 | 1.0 | perl itself | redistribute it and/or modify it under the same terms as perl itself
wtfpl | 100 | 1.0 | what the fuck | everyone is permitted to copy and distribute verbatim or modified copies(?s:.{0,400}?)what the fuck you want to
beerware | 100 | 1.0 | beer | if we meet some day, and you think this stuff is worth it, you can buy me a beer
json | 102 | 1.0 | for good, not evil | the software shall be used for good, not evil
ofl-1.1 | 100 | 1.0 | open font | this font software is licensed under the sil open font license
postgresql | 99 | 0.9 | without fee | permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee
hpnd | 98 | 0.9 | without fee is hereby granted | permission to use, copy, modify and distribute this software and its documentation for any purpose and without fee is hereby granted
x11 | 101 | 1.0 | x consortium | except as contained in this notice, the name of the x consortium shall not be used in advertising
ncsa | 101 | 1.0 | with the software without restriction | to deal with the software without restriction
openssl | 101 | 1.0 | openssl toolkit | this product includes software developed by the openssl project for use in the openssl toolkit
python-2.0 | 100 | 1.0 | psf hereby grants | psf hereby grants licensee a nonexclusive, royalty-free, world-wide license
bsl-1.0 | 98 | 0.9 | boost.org | boost\\.org/license_1_0\\.txt
mit | 91 | 1.0 | opensource.org | opensource\\.org/licenses/mit
bsd-3-clause | 91 | 1.0 | opensource.org | opensource\\.org/licenses/bsd-3-clause
bsd-2-clause | 91 | 1.0 | opensource.org | opensource\\.org/licenses/bsd-2-clause
gpl-3.0 | 92 | 1.0 | gnu.org/licenses | gnu\\.org/licenses/gpl-3\\.0
gpl-2.0 | 92 | 1.0 | gnu.org/licenses | gnu\\.org/licenses/(?:old-licenses/)?gpl-2\\.0
lgpl-2.1 | 92 | 1.0 | gnu.org/licenses | gnu\\.org/licenses/(?:old-licenses/)?lgpl-2\\.1
lgpl-3.0 | 92 | 1.0 | gnu.org/licenses | gnu\\.org/licenses/lgpl-3\\.0
agpl-3.0 | 92 | 1.0 | gnu.org/licenses | gnu\\.org/licenses/agpl-3\\.0
mpl-2.0 | 92 | 1.0 | mozilla.org | mozilla\\.org/mpl/2\\.0
epl-2.0 | 92 | 1.0 | eclipse.org | eclipse\\.org/legal/epl-2\\.0
unlicense | 92 | 1.0 | unlicense.org | unlicense\\.org
proprietary | 26 | 0.7 | trade secret | contains trade secrets|trade secrets? of
proprietary | 24 | 0.6 | may not be | may not be (?:reproduced|copied|distributed)(?s:.{0,120}?)without(?: the)?(?: express)?(?: prior)? written (?:permission|consent)
proprietary | 20 | 0.5 | all rights reserved | all rights reserved
proprietary | 25 | 0.7 | proprietary | (?:confidential and proprietary|proprietary and confidential)
gpl-other | 15 | 0.5 | general public license | gnu general public license
lgpl-other | 16 | 0.5 | lesser general public | gnu lesser general public license
"""

BASE_WEIGHT = 0.5

SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, n_detections bigint"


class Rule(NamedTuple):
    label: str
    priority: int
    weight: float
    #: Sets of keywords: each match holds one of each set.
    gates: tuple[frozenset[str], ...]
    pattern: re.Pattern


def _table(text: str, cells: int) -> list[list[str]]:
    return [[c.strip() for c in line.split(" | ", cells - 1)] for line in text.strip().splitlines()]


def _gate(keywords: str) -> frozenset[str]:
    return frozenset(keywords.split("; "))


def rules() -> list[Rule]:
    """All rules in order: the notices, then each family in each form."""
    out = [Rule(label, int(p), float(w), (_gate(key),), re.compile(rx.replace(" ", r"\s+") if "\\s" not in rx else rx)) for label, p, w, key, rx in _table(NOTICES, 5)]
    for label, key, name, spdx in (line.rsplit(" | ", 1)[0].split(" | ", 2) + [line.rsplit(" | ", 1)[1]] for line in FAMILIES.strip().splitlines()):
        for p, w, own, form in _table(FORMS, 4):
            gates = (_gate(own),) if "{spdx}" in form else (_gate(key), _gate(own))
            out.append(Rule(label, int(p), float(w), gates, re.compile(form.replace("{name}", f"(?:{name})").replace("{spdx}", f"(?:{spdx})"))))
    return list({r.pattern.pattern: r for r in reversed(out)}.values())[::-1]  # families of one SPDX identifier share its rule


_EXPRESSION = re.compile(r"(spdx-license-identifier:)([^\n\r]*)")
_TOKEN = re.compile(r"\s*(\(|\)|[a-z0-9.+-]*[a-z0-9+])")


def expanded(text: str) -> str:
    """The text with SPDX expressions of several licenses written as a line for each, so that each is found by its own rule. An expression is made of
    identifiers, `and`, `or`, `with` and brackets, and ends where that does; what follows `with` is an exception, and no license."""

    def lines(m: re.Match) -> str:
        found, end, due, rest = [], 0, True, m[2]
        while token := _TOKEN.match(rest, end):
            word = token[1]
            if word in ("and", "or", "with") and not due:
                due, exception = True, word == "with"
            elif word not in "()":
                if not due:
                    break
                if not found or not exception:
                    found.append(word)
                due, exception = False, False
            end = token.end()
        return m[0] if len(found) < 2 else "".join(f"{m[1]} {x}\n" for x in found) + rest[end:]

    return _EXPRESSION.sub(lines, text) if "spdx-license-identifier:" in text else text


class Scanner:
    """The rules behind their keyword automaton."""

    def __init__(self, found: list[Rule] | None = None):
        self.rules = rules() if found is None else found
        self.automaton = ahocorasick.Automaton()
        self.by_keyword: dict[str, list[int]] = {}
        for i, r in enumerate(self.rules):
            for k, gate in enumerate(r.gates):
                for keyword in gate:
                    self.by_keyword.setdefault(keyword, []).extend([] if k else [i])
        for keyword in self.by_keyword:
            self.automaton.add_word(keyword, keyword)
        self.automaton.make_automaton()

    def due(self, text: str) -> list[int]:
        """The rules whose keywords all occur."""
        seen = {keyword for _, keyword in self.automaton.iter(" ".join(text.split()))}  # keywords hold single blanks
        return sorted({i for keyword in seen for i in self.by_keyword[keyword] if not any(seen.isdisjoint(gate) for gate in self.rules[i].gates)})

    def detections(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, rule) of the kept detections in a lower-cased text, in order of start."""
        text = expanded(text)
        return self.resolve([(m.start(), m.end(), i) for i in self.due(text) for m in self.rules[i].pattern.finditer(text) if m.end() > m.start()])

    def resolve(self, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The detections that stay: by priority, then length, then start, and not within one that stays."""
        hits = sorted(hits, key=lambda h: (-self.rules[h[2]].priority, h[0] - h[1], h[0], h[2]))
        kept: list[tuple[int, int, int]] = []
        reach: list[tuple[int, int]] = []  # intervals of kept detections, none contained in another, by start
        for start, end, i in hits:
            if not contained(reach, start, end):
                kept.append((start, end, i))
        return sorted(kept)


def contained(reach: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether an interval of `reach` contains [start, end); else it is added, and those it contains go."""
    from bisect import bisect_left, bisect_right

    at = bisect_right(reach, (start, sys.maxsize))
    if at and reach[at - 1][1] >= end:
        return True
    low = bisect_left(reach, (start, 0))
    high = low
    while high < len(reach) and reach[high][1] <= end:
        high += 1
    reach[low:high] = [(start, end)]
    return False


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word's index, label) of each place where a phrase stands."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return out
        for phrase, label in BASE:
            start = at - len(phrase) + 1
            if start >= 0 and tuple(words[start : at + 1]) == phrase:
                out.append((start, label))


def scan(text: str | None, scanner: Scanner) -> tuple:
    low = lowered(utf8(text))
    words = plain_words(low)
    places = base_places(words)
    found = scanner.detections(low.decode())
    base = sorted({label for _, label in places})
    labels = sorted({*base, *(scanner.rules[i].label for _, _, i in found)})
    miss = 1.0
    for weight in [BASE_WEIGHT] * len(base) + [scanner.rules[i].weight for _, _, i in found]:
        miss *= 1 - weight
    starts = [s for s, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), 1 - miss if labels else 0.0, len(found)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base places, all labels, and a score: the chance that at least one detection is right. A map over rows: no shuffle."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in slices(frames):
            out = pd.DataFrame([scan(t, scanner) for t in frame["text"]], columns=names[1:])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            out.insert(0, names[0], frame["doc_id"].astype("Int64").to_numpy(dtype=object))
            yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, SCHEMA)
