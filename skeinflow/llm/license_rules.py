"""Signatures of licenses, written by hand: one line each of priority, label, keyword and regex over normalized words.

Priority says how much a signature tells: 95 a license's own text or its full title with version, 85 a header that grants or
names it, 75 an SPDX or metadata expression, 65 a link, 55 a clause that a family of licenses shares, 45 to 30 notices.
The keyword is a word that every match holds. ``#`` starts a comment.
"""

#: Fixed values.
SIGNATURES = """
# MIT and its relatives
95 mit granted permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
95 mit sublicense without limitation the rights to use copy modify merge publish distribute sublicense and or sell
55 mit substantial the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
85 mit mit (?:this|the) (?:project|software|code|library|package|work|repository) is (?:licensed|released|distributed|available) under the (?:terms of the )?mit licen[cs]e
85 mit mit (?:see|read) (?:the )?(?:file )?licen[cs]e (?:file )?(?:for|under) (?:the )?mit
75 mit mit (?:license|licence|licenses) mit
75 mit mit license osi approved mit license
65 mit mit opensource org licen[cs]es?(?: php)? mit(?: license)?(?: php| html)?
65 mit mit choosealicense com licenses mit
95 mit-0 granted permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:[^ ]+ ){60,80}furnished to do so the software is provided
75 mit-0 mit mit (?:no attribution|0)(?: licen[cs]e)?
95 x11 consortium except as contained in this notice the name of the x consortium shall not be used in advertising
85 x11 x11 (?:licensed|released|distributed) under the (?:terms of the )?x11 licen[cs]e
95 expat expat expat licen[cs]e
95 jsonlic evil the software shall be used for good not evil
75 jsonlic json the json licen[cs]e
95 ncsa illinois university of illinois ncsa open source licen[cs]e
75 ncsa ncsa licen[cs]e ncsa
95 mit-advertising advertising all advertising materials mentioning features or use of this software must display the following acknowledgement
# Apache
95 apache-2 apache apache licen[cs]e version 2 0 january 2004
85 apache-2 apache licensed under the apache licen[cs]e version 2(?: 0)?(?: the license)?
95 apache-2 compliance you may not use this file except in compliance with the license
95 apache-2 conditions unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
95 apache-2 contributor subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license
55 apache-2 contributor each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable (?:except as stated in this section )?patent license
75 apache-2 apache (?:license|licence) apache 2(?: 0)?
75 apache-2 apache license osi approved apache software license
75 apache-2 asl (?:license|licence|licensed under) asl 2(?: 0)?
65 apache-2 apache apache org licenses license 2 0(?: txt| html)?
65 apache-2 apache opensource org licen[cs]es?(?: php)? apache 2 0(?: php)?
95 apache-1.1 apache the apache software license version 1 1
55 apache-1.1 apache this product includes software developed by the apache software foundation
55 apache-1.0 apache this product includes software developed by the apache group for use in the apache http server project
55 apache-1.1 apache products derived from this software may not be called apache nor may apache appear in their name
85 apache-2-llvm llvm apache licen[cs]e v? ?2 0 with llvm exceptions
# GPL
95 gpl-1 general gnu general public license version 1 february 1989
95 gpl-2 general gnu general public license version 2 june 1991
95 gpl-3 general gnu general public license version 3 29 june 2007
95 gpl freedom the licenses for most software (?:and other practical works )?are designed to take away your freedom to share and change (?:it|the works)
95 gpl-3 general the gnu general public license is a free copyleft license for software and other kinds of works
85 gpl-2+ general it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
85 gpl-3+ general it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
85 gpl-1+ general it under the terms of the gnu general public license as published by the free software foundation either version 1 or at your option any later version
85 gpl-2 general it under the terms of (?:version 2 of )?the gnu general public license(?: version 2)? as published by the free software foundation version 2(?: of the license)?
85 gpl-2 general under the terms of the gnu general public license version 2 only
85 gpl-3 general under the terms of the gnu general public license version 3 only
55 gpl general you should have received a copy of the gnu general public license along with this (?:program|file|library|software)
55 gpl merchantability without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details
75 gpl-2 gpl license identifier gpl 2 0(?: only)?
75 gpl-2+ gpl license identifier gpl 2 0 or later
75 gpl-3 gpl license identifier gpl 3 0(?: only)?
75 gpl-3+ gpl license identifier gpl 3 0 or later
75 gpl-2 gplv2 (?:licensed under|license|licence|under the) (?:gnu )?gplv2
75 gpl-3 gplv3 (?:licensed under|license|licence|under the) (?:gnu )?gplv3
75 gpl general license osi approved gnu general public license(?: gpl)?
75 gpl-2 general license osi approved gnu general public license v2 gplv2
75 gpl-3 general license osi approved gnu general public license v3 gplv3
65 gpl gnu gnu org licenses gpl(?: html| txt)?
65 gpl-2 gnu gnu org licenses(?: old licenses)? gpl 2 0(?: en)?(?: html| txt)?
65 gpl-3 gnu gnu org licenses gpl 3 0(?: en)?(?: html| txt)?
65 gpl copyleft gnu org copyleft gpl html
95 gpl-classpath classpath gpl(?: v2| 2 0)? with (?:the )?classpath exception
95 gpl-classpath independent as a special exception the copyright holders of this library give you permission to link this library with independent modules
95 gpl-gcc gcc gcc runtime library exception version 3 1
95 gpl-bison bison as a special exception you may create a larger work that contains part or all of the bison parser skeleton
95 gpl-autoconf autoconf as a special exception (?:to the gnu general public license )?if you distribute this file as part of a program that contains a configuration script generated by autoconf
95 gpl-font font as a special exception if you create a document which uses this font
95 linux-syscall syscall (?:gpl 2 0 (?:only )?with )?linux syscall note
# LGPL, AGPL, FDL
95 lgpl-2 library gnu library general public license version 2 june 1991
95 lgpl-2.1 lesser gnu lesser general public license version 2 1 february 1999
95 lgpl-3 lesser gnu lesser general public license version 3 29 june 2007
85 lgpl-2.1+ lesser it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
85 lgpl-3+ lesser it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
85 lgpl-2+ library it under the terms of the gnu library general public license as published by the free software foundation either version 2 of the license or at your option any later version
55 lgpl lesser you should have received a copy of the gnu lesser general public license along with this (?:program|library|file|software)
55 lgpl library you should have received a copy of the gnu library general public license along with this library
75 lgpl-2.1 lgpl license identifier lgpl 2 1(?: only)?
75 lgpl-2.1+ lgpl license identifier lgpl 2 1 or later
75 lgpl-3 lgpl license identifier lgpl 3 0(?: only)?
75 lgpl-3+ lgpl license identifier lgpl 3 0 or later
75 lgpl-3 lgplv3 (?:licensed under|license|licence|under the) (?:gnu )?lgplv3
75 lgpl lesser license osi approved gnu lesser general public license(?: v2| v3)?
65 lgpl gnu gnu org licenses lgpl(?: 2 1| 3 0)?(?: en)?(?: html| txt)?
95 agpl-3 affero gnu affero general public license version 3 19 november 2007
95 agpl-1 affero affero general public license version 1 march 2002
85 agpl-3+ affero it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
55 agpl affero you should have received a copy of the gnu affero general public license along with this (?:program|file|software)
55 agpl-3 interacting your modified version must prominently offer all users interacting with it remotely through a computer network
75 agpl-3 agpl license identifier agpl 3 0(?: only| or later)?
75 agpl-3 agplv3 (?:licensed under|license|licence|under the) (?:gnu )?agplv3
65 agpl gnu gnu org licenses agpl(?: 3 0)?(?: html| txt)?
95 gfdl documentation gnu free documentation license version 1 [123] (?:march 2000|november 2002|3 november 2008)
85 gfdl documentation permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
55 gfdl invariant with no invariant sections no front cover texts and no back cover texts
65 gfdl gnu gnu org (?:licenses|copyleft) fdl(?: html| txt)?
# BSD family
95 bsd-4 advertising all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by
95 bsd-3 endorse (?:neither )?the names? of (?:[^ ]+ ){1,20}(?:nor the names of its contributors )?may (?:not )?be used to endorse or promote products derived from this software without specific prior written permission
85 bsd redistribution redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
55 bsd redistributions redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
55 bsd redistributions redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
55 bsd consequential in no event shall the copyright (?:holders?|owners?) or contributors be liable for any direct indirect incidental special exemplary or consequential damages
85 bsd bsd (?:this|the) (?:project|software|code|library|package|work) is (?:licensed|released|distributed|available) under (?:the|a) (?:terms of the )?bsd(?: style)? licen[cs]e
85 bsd bsd use of this source code is governed by a bsd style license
75 bsd-2 bsd license identifier bsd 2 clause
75 bsd-3 bsd license identifier bsd 3 clause
75 bsd-4 bsd license identifier bsd 4 clause
75 bsd-2-patent bsd bsd 2 clause (?:plus )?patent
75 0bsd 0bsd (?:license identifier 0bsd|zero clause bsd 0bsd|0bsd licen[cs]e)
75 bsd bsd license osi approved bsd license
75 bsd-3 clause (?:three|3) clause bsd licen[cs]e
75 bsd-2 clause (?:two|2) clause bsd licen[cs]e
65 bsd bsd opensource org licen[cs]es?(?: php)? bsd (?:license|2 clause|3 clause)(?: php)?
95 bsd-protection protection bsd protection license february 2002
55 bsd regents the regents of the university of california all rights reserved
# ISC, zlib, Boost and other short permissive texts
95 isc fee permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies
95 0bsd fee permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is
75 isc isc license identifier isc
75 isc isc license osi approved isc license(?: iscl)?
65 isc isc opensource org licenses isc(?: license)?
95 zlib misrepresented the origin of this software must not be misrepresented you must not claim that you wrote the original software
55 zlib altered altered source versions must be plainly marked as such and must not be misrepresented as being the original software
75 zlib zlib (?:the )?zlib libpng licen[cs]e
95 libpng png (?:the )?png reference library licen[cs]e(?: version 2)?
75 libpng libpng license identifier libpng(?: 2 0)?
95 boost-1.0 boost boost software license version 1 0 august 17(?:th)? 2003
85 boost-1.0 boost distributed under the boost software license version 1 0
95 boost-1.0 organization permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
65 boost-1.0 boost boost org license 1 0 txt
95 unlicense unencumbered this is free and unencumbered software released into the public domain
65 unlicense unlicense (?:http |https |refer to )?(?:http |https )?unlicense org
95 wtfpl fuck do what the fuck you want to(?: public license)?
65 wtfpl wtfpl (?:sam zoy org wtfpl|wtfpl net)
95 beerware beer if we meet some day and you think this stuff is worth it you can buy me a beer
75 beerware beerware (?:the )?beerware licen[cs]e
95 postgresql postgresql postgresql is released under the postgresql license
95 postgresql agreement permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted
95 hpnd documentation permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose(?: and)? (?:without fee )?is hereby granted (?:without fee )?provided that the above copyright notice appear in all copies
75 curl curl (?:license identifier curl|curl licen[cs]e)
95 curl stenberg copyright and permission notice copyright (?:c )?1996 (?:[^ ]+ ){1,8}daniel stenberg
95 openssl openssl this product includes software developed by the openssl project for use in the openssl toolkit
95 ssleay cryptographic this product includes cryptographic software written by eric young
75 openssl openssl (?:the )?openssl (?:and ssleay )?licen[cs]e
95 unicode unicode unicode license (?:agreement data files and software|v3)
95 icu icu icu license icu 1 8 1 and later
95 w3c w3c w3c software (?:and document )?notice and license
95 ijg independent this software is based in part on the work of the independent jpeg group
95 ftl freetype (?:the )?freetype project license
55 ftl freetype portions of this software are copyright (?:c )?(?:[^ ]+ ){1,4}the freetype project
95 info-zip info this is version (?:[^ ]+ ){1,6}of the info zip (?:copyright and )?license
95 vim vim vim license (?:i )?there are no restrictions on distributing unmodified copies of vim
75 vim vim (?:distributed under|license identifier) (?:the )?vim(?: license)?
95 tcl tcl tcl tk (?:license|licensing) terms
95 sqlite blessing the author disclaims copyright to this source code in place of a legal notice here is a blessing
95 fair instrument usage of the works is permitted provided that this instrument is retained with the works
75 blueoak oak blue oak model license(?: 1 0 0)?
75 upl universal universal permissive license(?: upl)?(?: version)? 1 0
75 mulan mulan mulan (?:psl v2|permissive software license(?: version)? 2)
75 naumen naumen naumen public license
95 psf-2 python python software foundation license version 2
95 python-cnri cnri cnri (?:open source )?license agreement(?: for python)?
65 psf python docs python org(?: 3)? license html
75 psf python license osi approved python software foundation license
95 php-3.01 php the php license version 3 01
85 php php this source file is subject to (?:the )?version 3 (?:0|01) of the php license
95 zpl zope zope public license zpl version 2 [01]
95 ruby ruby ruby is copyrighted free software by yukihiro matsumoto
75 ruby ruby (?:licensed|distributed|released) under the (?:same )?(?:terms (?:as|of) )?ruby(?: license| s)?
85 perl perl (?:this|it) is free software you can redistribute it and or modify it under the same terms as (?:the )?perl(?: 5)?(?: programming language system)?(?: itself)?
95 artistic-2 artistic the artistic license 2 0 copyright (?:c )?2000 2006 the perl foundation
95 artistic-1 intent the intent of this document is to state the conditions under which a package may be copied
75 artistic artistic license identifier artistic [12] 0
# Weak copyleft and corporate texts
95 mpl-1.1 mozilla the contents of this file are subject to the mozilla public license version 1 1
95 mpl-1.0 mozilla the contents of this file are subject to the mozilla public license version 1 0
95 mpl-2 mozilla this source code form is subject to the terms of the mozilla public license v 2 0
95 mpl-2 mozilla mozilla public license version 2 0 1 definitions
55 mpl-2 mpl if a copy of the mpl was not distributed with this file you can obtain one at
75 mpl-2 mpl license identifier mpl 2 0
75 mpl mozilla license osi approved mozilla public license(?: 1 [01]| 2 0)?
65 mpl mozilla mozilla org mpl(?: 2 0| 1 1)?
85 mpl-tri-license alternatively alternatively the contents of this file may be used under the terms of either the gnu general public license
95 npl netscape the contents of this file are subject to the netscape public license
95 epl-1 eclipse eclipse public license v(?:ersion)? ?1 0 the accompanying program is provided under the terms of this eclipse public license
85 epl-1 eclipse made available under the terms of the eclipse public license v1 0
85 epl-2 eclipse made available under the terms of the eclipse public license(?: v ?| version )2 0
75 epl-2 epl license identifier epl 2 0
65 epl eclipse eclipse org legal epl (?:v10|2 0|v20)(?: html)?
95 edl eclipse eclipse distribution license v(?:ersion)? ?1 0
95 cddl-1.0 cddl common development and distribution license cddl version 1 0
85 cddl development the contents of this file are subject to the terms of the common development and distribution license
75 cddl cddl license identifier cddl 1 [01]
95 cpl-1.0 common the accompanying program is provided under the terms of this common public license
95 ipl ibm ibm public license version 1 0
95 lpl lucent lucent public license version 1 0(?: 2)?
95 apsl apple the contents of this file (?:[^ ]+ ){0,12}subject to the apple public source license
75 apsl apple apple public source license(?: version)? [12] [012]
95 ms-pl microsoft microsoft public license ms pl
95 ms-rl microsoft microsoft reciprocal license ms rl
75 ms-pl microsoft license osi approved microsoft public license
95 eupl-1.2 european european union public licence v(?:ersion)? ?1 2 eupl
85 eupl eupl licensed under the eupl(?: version)?(?: v ?| )1 [12]
95 cecill cecill (?:this software is )?governed by the cecill(?: [abc]| b| c)? license under french law
75 cecill cecill cecill (?:free software license agreement|2 [01]|[bc])
75 qpl public q public license(?: version)? 1 0
95 sleepycat sleepycat (?:the )?sleepycat (?:software )?(?:public )?licen[cs]e
95 rpl reciprocal reciprocal public license(?: version)? 1 [15]
95 osl-3.0 open licensed under the open software license version 3 0
95 afl-3.0 academic licensed under the academic free license version 3 0
95 ecl-2 educational educational community license version 2 0
95 cpal attribution common public attribution license version 1 0
95 sissl sun sun industry standards source license
95 watcom watcom sybase open watcom public license
95 lppl latex (?:conditions of the )?latex project public license(?: either)?(?: version)? 1 [0-3]
85 lppl lppl (?:licensed|distributed|released) under (?:the )?(?:terms of the )?lppl
# Creative Commons, data and fonts
95 cc0-1.0 cc0 (?:creative commons )?cc0 1 0 universal
95 cc0-1.0 affirmer affirmer hereby overtly fully permanently irrevocably and unconditionally waives
85 cc0 waived (?:the author|the authors|[^ ]+ [^ ]+) has waived all copyright and related or neighboring rights
65 cc0 publicdomain creativecommons org publicdomain zero 1 0
65 cc-pdm publicdomain creativecommons org publicdomain mark 1 0
95 cc-by-4.0 attribution creative commons attribution 4 0 international(?: public)?(?: license)?
95 cc-by-sa-4.0 attribution creative commons attribution share ?alike 4 0 international
95 cc-by-nc-4.0 attribution creative commons attribution non ?commercial 4 0 international
95 cc-by-nc-sa-4.0 attribution creative commons attribution non ?commercial share ?alike 4 0 international
95 cc-by-nd-4.0 attribution creative commons attribution no ?derivatives 4 0 international
95 cc-by-nc-nd-4.0 attribution creative commons attribution non ?commercial no ?derivatives 4 0 international
95 cc-by-3.0 attribution creative commons attribution 3 0 (?:unported|united states|germany|france|spain)
95 cc-by-sa-3.0 attribution creative commons attribution share ?alike 3 0 (?:unported|united states|germany|france|spain)
65 cc-by creativecommons creativecommons org licenses by [1-4] [05]
65 cc-by-sa creativecommons creativecommons org licenses by sa [1-4] [05]
65 cc-by-nc creativecommons creativecommons org licenses by nc [1-4] [05]
65 cc-by-nd creativecommons creativecommons org licenses by nd [1-4] [05]
65 cc-by-nc-sa creativecommons creativecommons org licenses by nc sa [1-4] [05]
65 cc-by-nc-nd creativecommons creativecommons org licenses by nc nd [1-4] [05]
55 cc-by-sa remix if you remix transform or build upon the material you must distribute your contributions under the same license
55 cc-by credit you must give appropriate credit provide a link to the license and indicate if changes were made
55 cc-by-nc commercial you may not use the material for commercial purposes
85 cc-by-sa wikipedia text (?:from|of|in) wikipedia (?:[^ ]+ ){0,3}is available under the creative commons attribution share ?alike licen[cs]e
45 cc commons (?:some rights reserved|licensed under a) creative commons(?: licen[cs]e)?
95 odbl-1.0 database open data commons open database license(?: odbl)?(?: v(?:ersion)? ?)?1 0
95 odc-by attribution open data commons attribution license(?: odc by)?
95 pddl dedication open data commons public domain dedication (?:and )?license
95 ogl-uk government (?:contains public sector information )?licensed under the open government licence(?: v ?[123](?: 0)?)?
95 etalab ouverte licence ouverte(?: open licence)?(?: version)? 2 0(?: etalab)?
75 etalab etalab (?:licence ouverte etalab|etalab 2 0)
95 dl-de datenlizenz datenlizenz deutschland (?:namensnennung|zero)(?: version)? 2 0
75 cdla community community data license agreement (?:permissive|sharing)(?: version)?
95 ofl-1.1 font sil open font license version 1 1 26 february 2007
85 ofl-1.1 font this font software is licensed under the sil open font license version 1 1
95 ofl reserved with reserved font name
65 ofl scripts scripts sil org ofl
95 bitstream-vera bitstream bitstream vera is a trademark of bitstream
95 ubuntu-font ubuntu ubuntu font licence(?: version)? 1 0
95 fal artistic (?:free art license|licence art libre)(?: 1 [0-3])? (?:[^ ]+ ){0,8}artistic
# Source available, models, services
95 busl-1.1 business business source license 1 1
75 busl-1.1 change the change date (?:is|means) (?:[^ ]+ ){1,6}the change license
95 sspl server server side public license(?: sspl)?(?: version 1| v1)?
95 elastic-2 elastic elastic license(?: version)? 2 0
95 commons-clause clause commons clause license condition v1 0
95 polyform polyform polyform (?:noncommercial|small business|shield|strict|free trial|internal use|perimeter) license(?: 1 0 0)?
95 confluent confluent confluent community license(?: agreement)?(?: version 1 0)?
95 redis-sal redis redis source available license
95 hippocratic hippocratic hippocratic license(?: version)?
95 prosperity prosperity (?:the )?prosperity public license(?: 3 0 0)?
95 parity parity (?:the )?parity public license(?: 7 0 0| 6 0 0)?
95 openrail openrail (?:creativeml |bigscience |bigcode )?open ?rail(?: [ms])?(?: licen[cs]e)? openrail
75 openrail rail (?:creativeml|bigscience|bigcode) (?:open )?rail(?: [ms])?(?: v?1)?(?: 0)?(?: licen[cs]e)?
95 llama-community llama llama (?:2|3|3 1|3 2|3 3|4) community license(?: agreement)?
75 gemma-terms gemma gemma (?:terms of use|prohibited use policy)
95 nvidia-eula nvidia (?:nvidia software license agreement|license agreement for nvidia software development kits)
95 oracle-bcl oracle oracle binary code license agreement
95 intel-simplified intel intel simplified software license
95 unity-companion unity unity companion license
95 steam-ssa valve steam subscriber agreement valve
# Dual licences
90 dual-mit-apache either licensed under either of apache license version 2 0 (?:[^ ]+ ){0,14}or mit license
90 dual-mit-apache mit (?:dual licensed|licensed) under (?:both )?(?:the )?(?:mit (?:license )?(?:and|or) (?:the )?apache|apache (?:license )?2 0 (?:and|or) (?:the )?mit)(?: 2 0)?(?: licen[cs]es?)?
90 dual-mit-apache apache license identifier (?:mit or apache 2 0|apache 2 0 or mit)
90 dual-mit-gpl gpl (?:dual licensed|licensed) under (?:both )?(?:the )?mit (?:and|or) (?:the )?gpl(?: version 2| v2)?(?: licen[cs]es?)?
90 dual-bsd-gpl gpl dual bsd gpl
90 dual-mit-gpl gpl dual mit gpl
90 dual-commercial commercial (?:dual licensed|available under (?:a )?dual licen[cs]e) (?:[^ ]+ ){0,16}commercial licen[cs]e
# Notices without a license of their own
50 all-rights-reserved reserved all rights reserved
50 all-rights-reserved rechte alle rechte vorbehalten
50 all-rights-reserved droits tous droits réservés
50 all-rights-reserved derechos todos los derechos reservados
45 copyright copyright copyright (?:c |© )?(?:19|20)[0-9]{2}
45 copyright © (?:© )(?:19|20)[0-9]{2}
40 public-domain domain (?:released into|released to|dedicated to|placed in|is in) the public domain
40 public-domain copyright no copyright (?:is|claimed|protection) (?:claimed|in the united states|asserted)
40 us-government government this work was (?:prepared|created|produced) by (?:an )?(?:officers?|employees?) of the (?:u s|united states) government
35 eula user end user licen[cs]e agreement
35 eula agreement by (?:installing|downloading|copying|using|clicking) (?:[^ ]+ ){0,10}you (?:agree|accept) (?:to be bound by )?(?:to )?(?:the|this) (?:terms (?:of|and conditions of) this )?(?:licen[cs]e )?agreement
35 eula reverse you (?:may|shall|must) not (?:[^ ]+ ){0,8}reverse engineer decompile or disassemble
35 evaluation evaluation for (?:internal )?evaluation (?:and testing )?purposes only
35 non-commercial commercial (?:for|free for) (?:personal (?:and|or) )?non commercial (?:use|purposes) only
35 academic academic for (?:research and )?academic(?: and research)?(?: and educational)? (?:use|purposes) only
35 shareware shareware this (?:program|software) is shareware
35 freeware freeware this (?:program|software) is freeware
30 proprietary confidential (?:confidential and proprietary|proprietary and confidential)
30 proprietary trade (?:contains|constitutes) (?:confidential information and )?trade secrets of
30 proprietary unauthorized unauthorized (?:copying|reproduction|use|distribution) (?:or distribution )?of this (?:file|document|software|program) (?:[^ ]+ ){0,6}is strictly prohibited
30 permission-required permission (?:may not be|no part of this (?:work|publication|document|book) may be) (?:reproduced|copied|distributed|republished) (?:[^ ]+ ){0,16}without (?:the )?(?:prior )?(?:express )?(?:written )?permission
"""
