"""License wording as templates. The licenses' own texts, with their optional and replaceable regions marked.

<<beginOptional>>..<<endOptional>> may be missing; <<var;words="a-b">> stands for a to b words of any
kind, and <<var;words="a-b";match="..">> for words that each match the pattern.
"""

_COPIES = 'obtaining a copy of <<var;words="1-12">> the "Software", to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_BSD_ITEMS = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<var;words="0-1";match="1|a">> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer<<beginOptional>> as the first lines of this file unmodified<<endOptional>>. <<var;words="0-1";match="2|b">> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.'
_BSD_AS_IS = 'THIS SOFTWARE IS PROVIDED <<beginOptional>>BY <<var;words="1-12">> <<endOptional>>"AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;words="1-16">> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_GPL_COPY = 'is free software<<var;words="0-1";match="you">> can redistribute it and/or modify it under the terms of the GNU'
_GPL_REST = 'as published by the Free Software Foundation; either version'

TEMPLATES: dict[str, list[str]] = {
    "mit": [
        f'<<beginOptional>>MIT License <<endOptional>><<var;words="0-30">> Permission is hereby granted, free of charge, to any person {_COPIES} The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
        'licensed under the <<beginOptional>>terms of the <<endOptional>>MIT license',
        'released under the <<beginOptional>>terms of the <<endOptional>>MIT license',
        'SPDX-License-Identifier: MIT',
    ],
    "isc": [
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words="1-12">> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words="1-12">> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
        'SPDX-License-Identifier: ISC',
    ],
    "bsd-2-clause": [f'{_BSD_ITEMS} {_BSD_AS_IS}', 'SPDX-License-Identifier: BSD-2-Clause'],
    "bsd-3-clause": [
        f'{_BSD_ITEMS} <<var;words="0-1";match="3|c">> Neither the name of <<var;words="1-16">> may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_AS_IS}',
        'SPDX-License-Identifier: BSD-3-Clause',
    ],
    "apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var;words="1-4">> except in compliance with the License. You may obtain a copy of the License at <<var;words="0-8">> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        'licensed under the <<beginOptional>>terms of the <<endOptional>>Apache License, <<beginOptional>>Version <<endOptional>>2.0',
        'SPDX-License-Identifier: Apache-2.0',
    ],
    "gpl-2.0": [
        'licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, <<beginOptional>>version <<endOptional>>2',
        f'{_GPL_COPY} General Public License {_GPL_REST} 2 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.', 'SPDX-License-Identifier: GPL-2.0',
    ],
    "gpl-3.0": [
        'licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License, <<beginOptional>>version <<endOptional>>3',
        f'{_GPL_COPY} General Public License {_GPL_REST} 3 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.', 'SPDX-License-Identifier: GPL-3.0',
    ],
    "lgpl": [f'{_GPL_COPY} <<var;words="1-1";match="lesser|library">> General Public License {_GPL_REST} <<var;words="1-2";match="[0-9]+">> of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.'],
    "agpl-3.0": [f'{_GPL_COPY} Affero General Public License {_GPL_REST} 3 of the License, or <<beginOptional>>(at your option) <<endOptional>>any later version.', 'SPDX-License-Identifier: AGPL-3.0'],
    "cc-by": ['licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>Creative Commons Attribution <<var;words="1-2";match="[0-9]+">> <<var;words="0-3">> License'],
    "cc-by-nc": ['CC BY-NC<<beginOptional>> <<var;words="2-2";match="[0-9]+">><<endOptional>>', 'Creative Commons Attribution NonCommercial'],
    "cc-by-sa": ['CC BY-SA<<beginOptional>> <<var;words="2-2";match="[0-9]+">><<endOptional>>', 'Creative Commons Attribution ShareAlike'],
    "cc-by-nd": ['CC BY-ND<<beginOptional>> <<var;words="2-2";match="[0-9]+">><<endOptional>>', 'Creative Commons Attribution NoDerivatives'],
    "cc0": ['To the extent possible under law, <<var;words="1-16">> waived all copyright and related or neighboring rights to'],
    "mpl-2.0": ['This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at', 'SPDX-License-Identifier: MPL-2.0'],
    "zlib": [
        'This software is provided \'as-is\', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<var;words="0-1";match="1">> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var;words="0-1";match="2">> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var;words="0-1";match="3">> This notice may not be removed or altered from any source distribution.',
    ],
    "unlicense": [
        'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.',
    ],
}
