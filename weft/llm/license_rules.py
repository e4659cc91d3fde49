"""The signature rules of the licence scan, by hand.

A line is: label | priority | pattern ; pattern ; ... Patterns are regular expressions over
normalised text (lower case, words apart by one space, no punctuation); they match whole words. A
rule's keyword is the longest plain stretch of its pattern. Of overlapping detections
the one of higher priority wins; among equals the longer, then the earlier line.
"""

LINES = r"""
mit | 60 | mit licen[cs]e ; licensed under (the )?mit ; spdx license identifier mit ; opensource org licenses mit ; the mit expat licen[cs]e ; expat licen[cs]e mit
mit | 90 | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction ; to deal in the software without restriction including without limitation the rights to use copy modify merge
mit-0 | 70 | mit no attribution( licen[cs]e)? ; spdx license identifier mit 0 ; mit 0 licen[cs]e
apache-2.0 | 80 | apache licen[cs]e version 2( 0)? ; apache licen[cs]e 2 0 ; apache 2 0 licen[cs]e ; licensed under apache 2 0 ; spdx license identifier apache 2 0 ; apache org licenses license 2 0 ; apache license v2( 0)? ; asl 2 0 apache
apache-1.1 | 80 | apache (software )?licen[cs]e version 1 1 ; apache 1 1 licen[cs]e ; spdx license identifier apache 1 1 ; apache org licenses license 1 1
apache-1.0 | 80 | apache (software )?licen[cs]e version 1 0 ; spdx license identifier apache 1 0 ; apache org licenses license 1 0
apache | 50 | apache licen[cs]e ; apache software licen[cs]e ; licensed to the apache software foundation
gpl-2.0 | 75 | gnu general public licen[cs]e version 2 ; gnu gpl v(ersion )?2 ; gpl 2 0 only ; gpl v2 ; gplv2 ; spdx license identifier gpl 2 0( only)? ; gnu org licenses (old licenses )?gpl 2 0 ; general public licen[cs]e version 2
gpl-2.0-or-later | 85 | gnu general public licen[cs]e as published by the free software foundation either version 2 of the license or at your option any later version ; either version 2 of the license or at your option any later version ; spdx license identifier gpl 2 0 or later ; gpl 2 0 or later ; gpl v2 or later
gpl-3.0 | 75 | gnu general public licen[cs]e version 3 ; gnu gpl v(ersion )?3 ; gpl 3 0 only ; gpl v3 ; gplv3 ; spdx license identifier gpl 3 0( only)? ; gnu org licenses gpl 3 0 ; general public licen[cs]e version 3
gpl-3.0-or-later | 85 | either version 3 of the license or at your option any later version ; spdx license identifier gpl 3 0 or later ; gpl 3 0 or later ; gpl v3 or later
gpl-1.0 | 74 | gnu general public licen[cs]e version 1 ; gnu gpl v(ersion )?1 ; spdx license identifier gpl 1 0( only| or later)? ; gpl v1
gpl | 50 | gnu general public licen[cs]e ; general public licen[cs]e ; the terms of the general public licen[cs]e
lgpl-2.0 | 82 | gnu library general public licen[cs]e( version 2)? ; lgpl v2 ; lgplv2 ; spdx license identifier lgpl 2 0( only| or later)?
lgpl-2.1 | 82 | gnu lesser general public licen[cs]e version 2 1 ; lgpl v?2 1 ; lgplv2 1 ; spdx license identifier lgpl 2 1( only| or later)? ; gnu org licenses (old licenses )?lgpl 2 1 ; lesser general public licen[cs]e as published by the free software foundation either version 2 1
lgpl-3.0 | 82 | gnu lesser general public licen[cs]e version 3 ; lgpl v?3( 0)? ; lgplv3 ; spdx license identifier lgpl 3 0( only| or later)? ; gnu org licenses lgpl 3 0
lgpl | 62 | gnu lesser general public licen[cs]e ; lesser general public licen[cs]e
agpl-3.0 | 84 | gnu affero general public licen[cs]e version 3 ; affero general public licen[cs]e v3 ; gnu affero general public licen[cs]e as published by the free software foundation either version 3
agpl-3.0 | 84 | agpl v?3( 0)? ; agplv3 ; spdx license identifier agpl 3 0( only| or later)? ; gnu org licenses agpl 3 0
agpl-1.0 | 83 | affero general public licen[cs]e version 1 ; spdx license identifier agpl 1 0
agpl | 63 | gnu affero general public licen[cs]e ; affero general public licen[cs]e ; affero gpl
gfdl | 70 | gnu free documentation licen[cs]e( version 1 [123])? ; free documentation licen[cs]e version 1 [123]
gfdl | 70 | spdx license identifier gfdl 1 [123]( only| or later)? ; gnu org licenses fdl( 1 [123])?
bsd-2-clause | 76 | bsd 2 clause( licen[cs]e)? ; 2 clause bsd( licen[cs]e)? ; two clause bsd( licen[cs]e)? ; simplified bsd licen[cs]e ; freebsd licen[cs]e ; spdx license identifier bsd 2 clause ; opensource org licenses bsd 2 clause
bsd-3-clause | 77 | bsd 3 clause( licen[cs]e)? ; 3 clause bsd( licen[cs]e)? ; three clause bsd( licen[cs]e)? ; new bsd licen[cs]e ; modified bsd licen[cs]e ; revised bsd licen[cs]e ; spdx license identifier bsd 3 clause ; opensource org licenses bsd 3 clause
bsd-3-clause | 88 | neither the name of .{1,80}? nor the names of its contributors may be used to endorse or promote products derived from this software
bsd-4-clause | 78 | bsd 4 clause( licen[cs]e)? ; 4 clause bsd( licen[cs]e)? ; original bsd licen[cs]e ; bsd old licen[cs]e ; spdx license identifier bsd 4 clause
bsd-4-clause | 89 | all advertising materials mentioning features or use of this software must display the following acknowledg(e)?ment
bsd | 51 | bsd licen[cs]e ; bsd style licen[cs]e ; licensed under (the )?bsd ; berkeley software distribution licen[cs]e
bsd | 52 | redistribution and use in source and binary forms with or without modification are permitted
0bsd | 79 | zero clause bsd( licen[cs]e)? ; bsd zero clause( licen[cs]e)? ; spdx license identifier 0bsd ; 0bsd licen[cs]e ; free public licen[cs]e 1 0 0 bsd
isc | 70 | isc licen[cs]e ; spdx license identifier isc ; opensource org licenses isc ; internet systems consortium licen[cs]e isc
isc | 87 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
mpl-2.0 | 76 | mozilla public licen[cs]e (version |v )?2 0 ; mozilla public licen[cs]e v 2 0 ; mpl v?2 0 ; spdx license identifier mpl 2 0 ; mozilla org mpl 2 0 ; subject to the terms of the mozilla public licen[cs]e v 2 0
mpl-1.1 | 76 | mozilla public licen[cs]e version 1 1 ; mpl v?1 1 ; spdx license identifier mpl 1 1 ; mozilla org mpl 1 1
mpl-1.0 | 76 | mozilla public licen[cs]e version 1 0 ; spdx license identifier mpl 1 0
mpl | 55 | mozilla public licen[cs]e
epl-1.0 | 76 | eclipse public licen[cs]e (version |v )?1 0 ; eclipse public licen[cs]e v1 0 ; spdx license identifier epl 1 0 ; eclipse org legal epl v10
epl-2.0 | 76 | eclipse public licen[cs]e (version |v )?2 0 ; eclipse public licen[cs]e v2 0 ; spdx license identifier epl 2 0 ; eclipse org legal epl 2 0
epl | 55 | eclipse public licen[cs]e
edl-1.0 | 70 | eclipse distribution licen[cs]e( version 1 0| v1 0| v 1 0)?
cddl-1.0 | 76 | common development and distribution licen[cs]e version 1 0 ; cddl v?1 0 ; spdx license identifier cddl 1 0
cddl-1.1 | 76 | common development and distribution licen[cs]e version 1 1 ; cddl v?1 1 ; spdx license identifier cddl 1 1
cddl | 55 | common development and distribution licen[cs]e
cpl-1.0 | 70 | common public licen[cs]e( version 1 0| v1 0)?
cpal-1.0 | 70 | common public attribution licen[cs]e( version 1 0)?
ibm-1.0 | 70 | ibm public licen[cs]e( version 1 0)?
unlicense | 75 | the unlicense ; spdx license identifier unlicense ; unlicense org
unlicense | 88 | this is free and unencumbered software released into the public domain
cc0-1.0 | 76 | cc0 1 0( universal)? ; spdx license identifier cc0 1 0 ; creative commons cc0
cc0-1.0 | 76 | creativecommons org publicdomain zero 1 0
cc-by-1.0 | 76 | creative commons attribution 1 0 ; cc by 1 0 ; creativecommons org licenses by 1 0
cc-by-2.0 | 76 | creative commons attribution 2 0 ; cc by 2 0 ; creativecommons org licenses by 2 0
cc-by-2.5 | 76 | creative commons attribution 2 5 ; cc by 2 5 ; creativecommons org licenses by 2 5
cc-by-3.0 | 76 | creative commons attribution 3 0 ; cc by 3 0 ; creativecommons org licenses by 3 0
cc-by-4.0 | 76 | creative commons attribution 4 0 ; cc by 4 0 ; creativecommons org licenses by 4 0
cc-by-sa-2.0 | 78 | creative commons attribution share ?alike 2 0 ; cc by sa 2 0 ; creativecommons org licenses by sa 2 0
cc-by-sa-2.5 | 78 | creative commons attribution share ?alike 2 5 ; cc by sa 2 5 ; creativecommons org licenses by sa 2 5
cc-by-sa-3.0 | 78 | creative commons attribution share ?alike 3 0 ; cc by sa 3 0 ; creativecommons org licenses by sa 3 0
cc-by-sa-4.0 | 78 | creative commons attribution share ?alike 4 0 ; cc by sa 4 0 ; creativecommons org licenses by sa 4 0
cc-by-nc-3.0 | 78 | creative commons attribution non ?commercial 3 0 ; cc by nc 3 0 ; creativecommons org licenses by nc 3 0
cc-by-nc-4.0 | 78 | creative commons attribution non ?commercial 4 0 ; cc by nc 4 0 ; creativecommons org licenses by nc 4 0
cc-by-nd-3.0 | 78 | creative commons attribution no ?deriv(ative)?s 3 0 ; cc by nd 3 0 ; creativecommons org licenses by nd 3 0
cc-by-nd-4.0 | 78 | creative commons attribution no ?deriv(ative)?s 4 0 ; cc by nd 4 0 ; creativecommons org licenses by nd 4 0
cc-by-nc-sa-3.0 | 80 | creative commons attribution non ?commercial share ?alike 3 0 ; cc by nc sa 3 0 ; creativecommons org licenses by nc sa 3 0
cc-by-nc-sa-4.0 | 80 | creative commons attribution non ?commercial share ?alike 4 0 ; cc by nc sa 4 0 ; creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | 80 | creative commons attribution non ?commercial no ?deriv(ative)?s 4 0 ; cc by nc nd 4 0 ; creativecommons org licenses by nc nd 4 0
creative-commons | 45 | creative commons licen[cs]e ; under a creative commons ; licensed under creative commons
public-domain | 45 | (is|are) (placed |hereby placed )?in the public domain ; dedicated to the public domain ; released into the public domain ; public domain dedication
bsl-1.0 | 75 | boost software licen[cs]e( version 1 0| 1 0)? ; boost org license 1 0 ; distributed under the boost software licen[cs]e
bsl-1.0 | 75 | spdx license identifier bsl 1 0
busl-1.1 | 75 | business source licen[cs]e( 1 1| version 1 1)?
busl-1.1 | 75 | spdx license identifier busl 1 1
zlib | 70 | zlib licen[cs]e ; spdx license identifier zlib ; zlib libpng licen[cs]e ; opensource org licenses zlib
zlib | 87 | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
libpng | 70 | libpng licen[cs]e( version 2)? ; spdx license identifier libpng( 2 0)?
artistic-1.0 | 75 | artistic licen[cs]e (version )?1 0 ; spdx license identifier artistic 1 0( perl)?
artistic-2.0 | 75 | artistic licen[cs]e (version )?2 0 ; spdx license identifier artistic 2 0 ; perlfoundation org artistic licen[cs]e 2 0
artistic | 50 | (the )?artistic licen[cs]e ; under the same terms as perl itself artistic
perl | 50 | under the same terms as perl( 5)?( itself)?
python-2.0 | 72 | python software foundation licen[cs]e( version 2)? ; psf licen[cs]e( agreement)?( version 2)? ; spdx license identifier (python|psf) 2 0
ruby | 65 | ruby licen[cs]e ; spdx license identifier ruby ; same terms as ruby itself
php-3.01 | 72 | php licen[cs]e (version )?3 01 ; spdx license identifier php 3 01 ; php net license 3 01
php-3.0 | 71 | php licen[cs]e (version )?3 0 ; spdx license identifier php 3 0
postgresql | 70 | postgresql licen[cs]e ; spdx license identifier postgresql
openssl | 70 | openssl licen[cs]e ; spdx license identifier openssl ; openssl project for use in the openssl toolkit
ssleay | 70 | ssleay licen[cs]e ; original ssleay licen[cs]e
curl | 70 | curl licen[cs]e ; spdx license identifier curl
x11 | 70 | x11 licen[cs]e ; mit x11 licen[cs]e ; spdx license identifier x11
ncsa | 70 | university of illinois ncsa open source licen[cs]e ; ncsa open source licen[cs]e ; spdx license identifier ncsa
wtfpl | 72 | do what the fuck you want to public licen[cs]e
wtfpl | 72 | wtfpl( version 2| licen[cs]e)? ; spdx license identifier wtfpl
beerware | 72 | beer ?ware licen[cs]e ; spdx license identifier beerware ; buy me a beer in return
json | 72 | json licen[cs]e ; spdx license identifier json
json | 72 | the software shall be used for good not evil
ofl-1.1 | 72 | sil open font licen[cs]e( version 1 1| 1 1)? ; spdx license identifier ofl 1 1 ; open font licen[cs]e version 1 1 ; scripts sil org ofl
eupl-1.1 | 74 | european union public licen[cs]e (version |v )?1 1 ; eupl v?(ersion )?1 1 ; spdx license identifier eupl 1 1
eupl-1.2 | 74 | european union public licen[cs]e (version |v )?1 2 ; eupl v?(ersion )?1 2 ; spdx license identifier eupl 1 2
eupl | 55 | european union public licen[cs]e
cecill-2.1 | 74 | cecill (licen[cs]e )?(version )?2 1 ; spdx license identifier cecill 2 1
cecill-b | 74 | cecill b( licen[cs]e)?
cecill-c | 74 | cecill c( licen[cs]e)?
cecill | 55 | cecill( free software)? licen[cs]e
ms-pl | 72 | microsoft public licen[cs]e ; spdx license identifier ms pl ; ms pl licen[cs]e
ms-rl | 72 | microsoft reciprocal licen[cs]e ; spdx license identifier ms rl ; ms rl licen[cs]e
afl-3.0 | 72 | academic free licen[cs]e( version| v)? ?3 0 ; spdx license identifier afl 3 0
afl | 55 | academic free licen[cs]e
osl-3.0 | 72 | open software licen[cs]e( version| v)? ?3 0 ; spdx license identifier osl 3 0
osl | 55 | open software licen[cs]e
qpl-1.0 | 70 | q public licen[cs]e( version 1 0)?
sleepycat | 70 | sleepycat licen[cs]e ; spdx license identifier sleepycat
sspl-1.0 | 74 | server side public licen[cs]e( version 1| v1)? ; spdx license identifier sspl 1 0
elastic-2.0 | 74 | elastic licen[cs]e( version)? ?2 0 ; spdx license identifier elastic 2 0
elastic | 55 | elastic licen[cs]e
commons-clause | 74 | commons clause( licen[cs]e condition)?( v1 0)?
polyform | 70 | polyform (noncommercial|small business|strict|shield|perimeter|internal use) licen[cs]e
unicode | 70 | unicode (inc )?licen[cs]e( agreement)? ; spdx license identifier unicode (dfs 2016|3 0|tou)
w3c | 70 | w3c software( notice)?( and)?( document)? licen[cs]e ; spdx license identifier w3c
vim | 70 | vim licen[cs]e ; spdx license identifier vim
ntp | 70 | ntp licen[cs]e ; spdx license identifier ntp
hpnd | 70 | historical permission notice and disclaimer
upl-1.0 | 72 | universal permissive licen[cs]e( version| v)? ?1 0 ; spdx license identifier upl 1 0
zpl-2.1 | 72 | zope public licen[cs]e( version)? ?2 1 ; spdx license identifier zpl 2 1
zpl | 55 | zope public licen[cs]e
ecl-2.0 | 72 | educational community licen[cs]e( version)? ?2 0 ; spdx license identifier ecl 2 0
blueoak-1.0.0 | 72 | blue oak model licen[cs]e( 1 0 0)? ; spdx license identifier blueoak 1 0 0
mulan-2.0 | 72 | mulan (psl|permissive software licen[cs]e)( v2| version 2)? ; spdx license identifier mulanpsl 2 0
odbl-1.0 | 72 | open (data commons open )?database licen[cs]e( v1 0| 1 0)? ; spdx license identifier odbl 1 0 ; opendatacommons org licenses odbl
odc-by-1.0 | 72 | open data commons attribution licen[cs]e( v1 0)? ; spdx license identifier odc by 1 0 ; opendatacommons org licenses by
pddl-1.0 | 72 | public domain dedication and licen[cs]e( v1 0)? ; spdx license identifier pddl 1 0 ; opendatacommons org licenses pddl
cdla-permissive | 72 | community data licen[cs]e agreement permissive( version)?( 1 0| 2 0)?
cdla-sharing | 72 | community data licen[cs]e agreement sharing( version)?( 1 0)?
openrail | 70 | open ?rail( m)? licen[cs]e ; responsible ai licen[cs]e openrail ; bigscience (bloom )?rail licen[cs]e
all-rights-reserved | 40 | all rights reserved
proprietary | 42 | proprietary and confidential ; proprietary licen[cs]e ; unauthorized copying of this file via any medium is strictly prohibited
spdx-other | 30 | spdx license identifier [a-z0-9]+
"""
