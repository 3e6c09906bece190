"""License templates: wording that must stand exactly, with optional and replaceable regions marked.

The markup follows the public matching guidelines for license lists: text between <<beginOptional>> and
<<endOptional>> may be missing, <<var;words=a-b>> stands for any a to b words. Words are compared after A-Z are
lower-cased and punctuation is dropped, so the templates are written without either. A license is there only with all
of its mandatory wording, disclaimers included; short notices have labels of their own.
"""

# Wording of public licenses and notices.
_NO_ENDORSEMENT = """<<beginOptional>>3<<endOptional>> neither the name of <<var;words=1-12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission"""
_BSD = """redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions
        are met <<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must reproduce the above
        copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution {third} this software is provided by <<var;words=1-12>> as is and any express or implied warranties including but not
        limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall
        <<var;words=1-12>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited
        to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory
        of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of
        this software even if advised of the possibility of such damage"""
_GPL = """is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free
        software foundation either version {version} of the license or at your option any later version <<var;words=1-4>> is distributed in
        the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
        particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public
        license along with"""
#: A document with the whole wording of a license scores 1, one with a notice (labels in `-notice`) NOTICE, one with a base phrase alone 0.5.
NOTICE = 0.75
TEMPLATES = {
    "mit-text": """permission is hereby granted free of charge to any person obtaining a copy of <<var;words=1-4>> and associated documentation
        files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
        publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
        subject to the following conditions the above copyright notice and this permission notice <<beginOptional>>including the next
        paragraph<<endOptional>> shall be included in all copies or substantial portions of the software the software is provided as is
        without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and noninfringement in no event shall <<var;words=1-8>> be liable for any claim damages or other liability
        whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software""",
    "isc-text": """permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without
        fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and <<var;words=1-8>> disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall <<var;words=1-8>> be liable for any special direct indirect or consequential damages
        or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious
        action arising out of or in connection with the use or performance of this software""",
    "bsd-2-clause": _BSD.format(third=""),
    "bsd-3-clause": _BSD.format(third=_NO_ENDORSEMENT),
    "apache-2.0": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you
        may obtain a copy of the license at <<var;words=1-1>> www apache org licenses license 2 0 unless required by applicable law or
        agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of
        any kind either express or implied see the license for the specific language governing permissions and limitations under the
        license""",
    "gpl-2.0-or-later": _GPL.format(version=2),
    "gpl-3.0-or-later": _GPL.format(version=3),
    "apache-2.0-notice": """licensed under the apache license version 2 0""",
    "gpl-2.0-notice": """the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 2""",
    "gpl-3.0-notice": """the gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>>
        <<beginOptional>>either<<endOptional>> version 3""",
    "mit-notice": """under the <<beginOptional>>terms of the<<endOptional>> mit license""",
    "cc-by-4.0-notice": """under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>>
        cc by 4 0""",
    "cc-by-nc-4.0-notice": """under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative
        commons<<endOptional>> cc by nc 4 0""",
    "cc-by-sa-4.0-notice": """under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> <<beginOptional>>creative
        commons<<endOptional>> cc by sa 4 0""",
    "spdx-notice": """spdx license identifier <<var;words=1-2>>""",
}
