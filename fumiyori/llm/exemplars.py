"""Labelled exemplars of template residue (problem 10), written as patterns with alternatives.

``(a|b|)`` stands for each of its parts, so one line yields many phrases. ``§`` is an unfilled
placeholder, ``¤`` a bracket that ordinary text has too, before the words in it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

# Names of fields that stand in placeholders.
FIELDS = (
    "title subtitle name author editor translator publisher year date month day time place city town country region address email mail phone tel user username summary abstract body text content caption heading id number price url link "
    "kana work card item page section topic keyword company product description image photo source language category "
    "your here insert enter add placeholder tbd todo xxx tk 名前 氏名 題名 題目 作品名 著者 著者名 作者 作者名 訳者 住所 日付 年月日 発表年 番号 概要 要約 項目 内容 本文 見出し 地名 会社名 商品名 電話番号 入力 記入 挿入 未設定 未定 入れて 姓名 标题 作者名 日期 内容 이름 제목 날짜 내용 nom titre auteur datum titel"
).split()

# Phrases by label. Those that begin with "~" are said in ordinary text too: they count only as the
# whole of a sentence, the others inside one as well.
PATTERNS = {
    "placeholder": """
§
""",
    "filler": """
(lorem ipsum dolor|lorem ipsum dolor sit amet)
~lorem ipsum
~(blindtext|platzhaltertext|beispieltext|mustertext)
hier steht (später|noch|) (der|ein) (richtige|eigentliche|) text
~(placeholder|dummy|sample|filler) (paragraph|text|content|copy)
(placeholder|dummy|sample|) (paragraph|text|content) for layout purposes only
~(insert|add|enter|type|put) (your |the |)(text|content|copy|description|title|story) here
your (text|content|title|description) (goes|comes|will go|will appear) here
~(text|content|copy|translation|summary|description|article) (to follow|to come|goes here|to be added|to be written|to be announced|to be supplied)
~to be (announced|added|supplied)
~(tbd|tba|tbc|text text|text text text|n a)
~todo (write|add|fill in|finish|insert|complete) (this |the |)(section|text|chapter|paragraph|part|page|content|story)
~todo
~texte (provisoire|temporaire|factice|de remplissage|provisoire à remplacer)
~(insérer|saisissez|entrez|placez) (le|votre|un) (texte|contenu|titre) ici
~votre (texte|contenu) (ici|sera inséré ici)
(此处|这里)为(示例|占位|测试)(文字|文本|内容)
(此处|这里|此)(输入|填写|插入)(文字|文本|内容|标题|正文)
(내용을|텍스트를|제목을|본문을) (입력하세요|입력해 주세요|입력하십시오|넣으세요)
~(샘플|더미|예시) (텍스트|문장|본문)입니다
ここに(本文|テキスト|文章|文字|内容|説明|説明文|タイトル|見出し)(が入ります|を入れて|を入力して|を記入して|を挿入して)
(本文|テキスト|文章|文字|説明文|タイトル|見出し|文言|写真|画像)(が入ります|を入力してください|を入れてください)
~(テキスト|サンプル|ダミー|テスト|説明文|本文|文章)(テキスト|サンプル|ダミー|テスト|説明文|本文|文章)
~(サンプル|ダミー|テスト|仮)(テキスト|文章|原稿|の文章)
~(本文|内容|説明|見出し|題名)(未入力|未設定|未記入)
~(文章|テキスト|文)は(ダミー|サンプル|仮のもの)です
文字の大きさ、量、字間、行間等を確認するために入れています
~(asdf|asdf asdf|asdf jkl|qwerty|foo bar|foo bar baz|test test|test test test|aaa bbb ccc|xxx xxx|xxxx xxxx|xxxxx xxxxx|blah blah blah)
~(あああ いいい|ああああ いいいい|あああああ いいいいい|あああああああああああ)
""",
    "announcement": """
~(準備中|工事中|作成中|執筆中|制作中|製作中|編集中|翻訳中)(です|となっております|でございます)
(本文|作品|ページ|サイト|内容|続き|頁)は(現在|ただいま|)(準備中|工事中|作成中|執筆中|制作中|編集中)です
~(後日|近日|近日中に|追って|まもなく|間もなく)(公開|掲載|追加|更新|配信)(予定|します|いたします)
~(乞うご期待|今しばらくお待ちください|公開までしばらくお待ちください)
~(まだ|未だ)(公開|掲載)(されていません|しておりません)
~(coming soon|coming shortly|check back soon|check back later|stay tuned)
(page|site|section|article|entry|chapter|website) is (currently |still |)(under construction|being (prepared|written|updated)|in preparation)
~(under construction|work in progress)
~(content|text|page|section|article) (is coming soon|coming soon|will be (available|added|published) (soon|later|shortly)|will follow)
~(demnächst|bald|in kürze) (hier|verfügbar|mehr)
(seite|website|rubrik) (ist|befindet sich) (noch|derzeit|gerade|) (im aufbau|in bearbeitung|in vorbereitung)
~(inhalt|text|seite) (folgt|folgt in kürze|in vorbereitung|im aufbau)
~(bientôt disponible|prochainement|disponible prochainement|à venir|en cours de rédaction|en construction)
(page|section|rubrique) est en (cours de (construction|rédaction|préparation)|construction|préparation)
~(即将推出|敬请期待|即将上线|即将发布|正在建设中|内容准备中|尚在准备中|稍后公布)
~(本页|此页|页面|网站|内容|正文)(正在|尚在|)(建设中|准备中|更新中|编辑中|制作中)
~(준비 중입니다|준비중입니다|공사 중입니다|곧 공개됩니다|추후 공개 예정입니다)
(본문은|페이지는|콘텐츠는|내용은) (현재 |아직 |)(준비 중입니다|준비중입니다|작성 중입니다)
""",
    "error": """
(#400 bad request|#401 unauthorized|#403 forbidden|#404 not found|#405 method not allowed|#408 request timeout|#410 gone|#429 too many requests|#500 internal server error|#501 not implemented|#502 bad gateway|#503 service unavailable|#503 service temporarily unavailable|#504 gateway time out|#504 gateway timeout)
~(error|http error|status|http status|code|error code|fehler|erreur|エラー|エラーコード|错误|오류) (#400|#401|#403|#404|#405|#408|#410|#429|#500|#501|#502|#503|#504)
~(internal server error|bad gateway|gateway timeout|gateway time out|service unavailable|service temporarily unavailable|bad request|request timeout|too many requests|method not allowed)
~(page|file|document|resource|article|site|url|object) (not found|does not exist|cannot be found|could not be found|no longer exists|is not available|unavailable|missing)
~not found
~(requested|looking for) (page|url|file|document|resource|article) (was not found|could not be found|cannot be found|does not exist)
(page|url|file|document|resource|article) (was not found|could not be found|cannot be found) on this server
(requested url|url you requested|page you requested|page you are looking for|file you requested) (was not found|could not be found|does not exist|has been (moved|removed|deleted)|is not available|may have been (moved|removed|deleted))
~(could not|couldn t|can t|cannot|unable to) find (the|that|this) (page|file|document|article)
~(something went wrong|error has occurred|unexpected error|internal error|unknown error|fatal error|script error|server error)
~(looks like|it looks like) something (broke|went wrong)( on our (end|side)|)
~(request|page|form|submission) (could not|cannot|can not) be (processed|completed|loaded|displayed)
~(can t|couldn t|could not|cannot) (seem to |)find what you (were|are) looking for
~(link|url|address) (you followed |you clicked |)(may|might) (be|have been) (broken|expired|removed|moved|incorrect)
~(page|article|content|file) (may|might) have been (removed|moved|deleted|renamed)
~http (#400|#401|#403|#404|#500|#502|#503)
(an|unknown|unexpected|internal|fatal|server|database|script|system|application) error (occurred|has occurred|while processing)
(server|site|service) is (temporarily|currently) (unavailable|unable|not responding|overloaded|down)
unable to (service|handle|process|complete) your request
upstream did not answer in time
~(server|upstream|request|connection|gateway) (timed out|did not (respond|answer)|was reset|was refused)
(error|failed) (establishing|to establish|opening) a database connection
~(database|mysql|sql|query|connection) (error|failed|failure)
(query failed too many connections|too many connections errno 0|call to undefined function|undefined variable|undefined index|uncaught exception|division by zero|allowed memory size of 0 bytes exhausted|maximum execution time of 0 seconds exceeded|cannot modify header information|syntax error unexpected)
(view|index|main|render) php on line 0
traceback most recent call last
file (render|main|app|index) py line 0 in (module|body|main)
~(keyerror|valueerror|typeerror|nameerror|attributeerror|indexerror|importerror|runtimeerror|zerodivisionerror|nullpointerexception|nullreferenceexception|stackoverflowerror|outofmemoryerror)
~(keyerror|valueerror|typeerror|attributeerror|indexerror) (text|none|object has no attribute|list index out of range)
(segmentation fault core dumped|unhandled exception|exception in thread main|caused by java|uncaught typeerror)
(java lang|java util|java io) (nullpointerexception|runtimeexception|illegalstateexception|illegalargumentexception|ioexception|exception|error)
(page|main|app|index) java 0
~(seite|datei|url|adresse) (wurde nicht gefunden|nicht gefunden|existiert nicht|ist nicht verfügbar|konnte nicht gefunden werden)
(angeforderte|gewünschte|gesuchte) (seite|datei|url|adresse) (wurde|konnte) nicht gefunden
~(fehler ist aufgetreten|serverfehler|interner serverfehler|server nicht erreichbar|dienst nicht verfügbar)
~(anfrage|seite) (konnte|kann) nicht (bearbeitet|verarbeitet|geladen|angezeigt) werden
~(page|fichier|adresse|ressource) (est introuvable|introuvable|n existe pas|n existe plus|n a pas été trouvée|non trouvée)
(page|adresse|ressource) (demandée|recherchée) (est introuvable|introuvable|n existe pas|n existe plus|n a pas été trouvée)
~(erreur s est produite|erreur est survenue|erreur inattendue|erreur interne)
~(service|site|serveur|page) (temporairement |momentanément |)(indisponible|inaccessible)
~(お探し|ご指定|ご要望)の(ページ|ファイル|URL|記事|作品|アドレス)
~(指定された|要求された|該当する|リクエストされた)(ページ|ファイル|URL|記事|アドレス)
~(ページ|ファイル|URL|記事|アドレス|コンテンツ)(は|が)(見つかりません|存在しません|ありません|削除されました|表示できません|見当たりません)
(お探し|ご指定)のページ(は|が)(見つかりません|存在しません|ありません|削除|移動|表示できません)
移動(または|もしくは|、または)削除された可能性があります
~(ページ|サーバー|サーバ|データベース|システム|内部|接続|通信|予期しない|予期せぬ|不明な|サーバー内部|データベース接続)エラー
~(サーバー|サーバ|データベース|システム|内部|通信|接続|予期しない|予期せぬ|不明な|)エラーが発生(しました|しています|いたしました)
(サーバー|サーバ|データベース|システム|予期しない)エラーが発生しました
~(サーバー|サーバ|データベース)(に|へ)接続できません
~(接続|セッション|通信|リクエスト)がタイムアウト(しました|になりました)
~(サーバー|サーバ)(には|に)(ありません|存在しません|見つかりません)
~(页面|网页|文件|您访问的页面|您要找的页面|您请求的页面)(不存在|未找到|找不到|没有找到|无法找到|已被删除|已被移除|无法显示)
(页面|网页|文件)不存在或(已被|已)(删除|移除|移动)
~(找不到|无法找到|未找到|没有找到)(该|此|您要的|您请求的|)(页面|网页|文件|服务器)
~(服务器|系统|内部|数据库|网络|数据库连接|服务器内部)(错误|发生错误|出错|连接失败|无法连接|繁忙)
~(发生|出现)(错误|未知错误|了错误|了一个错误)
~(网页|页面|网站|服务器)(无法访问|无法打开|暂时无法访问)
~(内容|页面|文章|商品)(已下架|已删除|已被删除|已失效)
~(페이지를|파일을|문서를|주소를) (찾을 수 없습니다|찾지 못했습니다)
(요청하신|찾으시는) (페이지를|파일을|문서를) (찾을 수 없습니다|찾지 못했습니다)
~페이지가 (존재하지 않습니다|삭제되었습니다|없습니다)
~(존재하지 않는|삭제된|찾을 수 없는) 페이지입니다
~(오류가|에러가) (발생했습니다|발생하였습니다)
~(서버에|데이터베이스에) (연결할 수 없습니다|접속할 수 없습니다)
""",
    "access": """
(アクセス|サーバー|回線)が(大変|非常に|)(集中して|混み合って)(おります|います)
しばらく(時間を|)(おいて|経って|たって)から(再度|もう一度|)お試し
(セッション|ログイン)(の|は)(有効期限|期限)(が|は)切れ(ました|ています)
~(有効期限|期限)(が|は)切れ(ました|ています)
(再度|もう一度|改めて)(ログイン|サインイン)してください
~(ログイン|サインイン|会員登録)(して|を行って)ください
(閲覧|ご覧|表示|利用|続きを読む|続きを見る)(する|)に(は|)(ログイン|会員登録|サインイン|認証)が必要
~(ログイン|会員登録|サインイン|認証)が必要です
~(会員|会員の方|ログインした方|登録者)のみ(ご覧いただけます|閲覧できます|ご利用いただけます|閲覧可能です)
~(会員|登録会員)(限定|専用)(の|)(ページ|記事|コンテンツ)です
~(アクセス|閲覧|表示)(が拒否されました|が禁止されています|は許可されていません|が制限されています|する権限がありません|権限がありません)
~(認証|ログイン|本人確認)に失敗しました
認証に失敗しました エラーコード
~(ユーザー名|パスワード)(が正しくありません|が違います|を入力してください)
~(システム|サーバー|サーバ|サイト|ただいま|只今|現在|定期|緊急|)(メンテナンス|保守作業|点検作業)中です
(システム|サーバー|サイト|定期|緊急)(メンテナンス|保守)(中|)のため
~(メンテナンス|保守作業|点検)(中|)のため、(現在|ただいま|一時的に|)(ご利用いただけません|停止|アクセスできません|表示できません)
現在(ご利用いただけません|サービスを停止しております)
(please |)(log in|login|sign in|sign up|register|subscribe) to (continue|view|read|access|see|proceed)
~(please |)(log in|login|sign in) (again|)
~(login|log in|sign in|registration|subscription|membership|authentication|authorization) (is |)required
your session (has expired|has timed out|timed out|expired)
~(session expired|invalid password|incorrect password|wrong password|invalid username or password|login failed)
~access (denied|forbidden|restricted)
~access to this (page|document|resource|content|site) (is|has been) (denied|restricted|forbidden|blocked)
do not have (permission|access|authorization|sufficient rights) to (view|access|read|open|see) this
not (authorized|permitted) to (view|access|read|open|see) this (page|document|resource|content|file)
(complete|solve) the captcha
~(verify|confirm|prove) (that |)you are (a |)(human|not a robot)
(checking|verifying) your browser
~(down|offline|closed|unavailable) (for|due to) (scheduled |planned |)maintenance
(site|website|service|page|server|system) is (currently |temporarily |)(down|offline|closed|under|undergoing) (for |)maintenance
~(under|scheduled|undergoing|planned|system|site) maintenance
~(try again later|check back later|come back later|try again in a few minutes)
~(subscribe|register|upgrade) to (continue reading|read the full (article|story|text))
~(content|page|article|story|section) is (for|available to|only for|reserved for) (members|subscribers|registered users)( only|)
~(members|subscribers) only
~(reached|used up|exceeded) (your|the) (limit|number) of free (articles|stories|pages)
~(scheduled|planned|unplanned|server) (downtime|outage)
~(wait|hold on) while we (verify|check) your (browser|connection)
(seite|system|server|website) (wird|ist) (gerade|derzeit|momentan|zurzeit|) (gewartet|in wartung|wegen wartungsarbeiten)
~(wartungsarbeiten|wartungsmodus)
~(melden sie sich an|loggen sie sich ein|bitte anmelden|bitte einloggen|anmeldung erforderlich|anmeldung fehlgeschlagen)
~(zugriff|zugang) (verweigert|nicht gestattet|nicht erlaubt)
~keine (berechtigung|zugriffsrechte)
~sitzung ist abgelaufen
~(nur für|nur) (mitglieder|abonnenten|angemeldete nutzer|registrierte nutzer)( sichtbar| zugänglich| lesbar|)
~accès (refusé|interdit|non autorisé)
~(veuillez|merci de) vous (connecter|identifier|authentifier)
~(connexion|authentification|identification) (requise|nécessaire)
~session a expiré
~(devez|doit) être (connecté|abonné|inscrit|identifié)
~réservé aux (membres|abonnés)
~(site|service|page|serveur) (est |)(actuellement |)en (cours de |)maintenance
~(请先|请|您需要先|需要)(登录|登入|注册)
~(登录后|注册后)(查看|才能查看|可见|继续阅读|即可阅读)
~(拒绝访问|访问被拒绝|禁止访问|访问受限|没有权限|您没有权限访问此页面|无权访问)
~(系统|网站|服务器|页面)(正在|)(维护中|维护|升级中|维护升级中)
~(登录|会话)(已过期|已超时|超时)
~(请稍后再试|请稍后重试|稍后再试)
~(로그인이|회원가입이|인증이) 필요합니다
~(로그인 후|회원가입 후) (이용해 주세요|이용하실 수 있습니다|볼 수 있습니다|이용 가능합니다)
~다시 로그인해 주세요
~(접근이|접속이|액세스가) (거부되었습니다|제한되었습니다|차단되었습니다)
~(접근 권한이|열람 권한이) 없습니다
~(회원만|로그인한 사용자만|가입자만) (볼|이용할|열람할) 수 있습니다
~(세션이|로그인이) 만료되었습니다
~(현재|시스템|서버|사이트) (점검 중입니다|점검중입니다|유지보수 중입니다)
~(잠시 후|나중에) 다시 시도해 (주세요|주십시오)
""",
    "script": """
~(javascript|scripts|cookies|cookies and scripts) (is|are|must be) (required|disabled|turned off|switched off|not enabled|not supported|blocked|enabled|needed)
(cookies and scripts|javascript and cookies) are required to (view|read) the (text|page)
~(site|page|website|application|app|reader) (requires|needs|depends on|uses) (javascript|scripts|cookies)
(site|page|website|app|reader) works only with (javascript|scripts) (switched on|enabled|turned on)
~(enable|turn on|activate|allow|switch on) (javascript|scripts|cookies)
(enable|turn on|activate|allow) (javascript|scripts|cookies) (to run this app|to view this (page|site)|to continue|in your browser|and reload)
~browser (does not support|has disabled|is blocking) (javascript|scripts)
~noscript
check that scripts are (allowed|enabled)
~loading if nothing appears
(JavaScript|スクリプト|ジャバスクリプト|クッキー|Cookie)を有効にし(てください|て下さい)
~(JavaScript|スクリプト|ジャバスクリプト|クッキー|Cookie)(を有効|が無効|が有効|をオンに|が必要|の有効化)
ブラウザ(では|は|の)(スクリプト|JavaScript)(が無効|に対応していません|を有効)
~設定を変更してください
~(JavaScript|スクリプト)に対応したブラウザ
~(aktivieren|erlauben) sie (javascript|skripte|cookies)
aktivieren sie javascript um diese seite
~(javascript|skripte) (ist|sind|wird|muss) (deaktiviert|erforderlich|benötigt|aktiviert sein|nicht aktiviert)
~(seite|website) (benötigt|erfordert) javascript
~(activer|autoriser) (javascript|les scripts|les cookies)
activer javascript pour (afficher|voir|lire)
~javascript (est désactivé|est requis|est nécessaire|doit être activé)
~(site|page) (nécessite|requiert|utilise) javascript
(启用|开启|允许)(脚本|JavaScript)
(启用|开启)(脚本|JavaScript)后(重新加载|刷新|继续)(本页|页面|)
~浏览器(不支持|禁用了|已禁用|未启用)(脚本|JavaScript)
~(本站|本页|此网站|此页面)需要(启用|)(脚本|JavaScript)
(자바스크립트를|스크립트를|JavaScript를) (활성화해|사용하도록 설정해|켜) (주세요|주십시오)
~(자바스크립트가|스크립트가|JavaScript가) (비활성화되어 있습니다|필요합니다|꺼져 있습니다)
""",
}

# Words that go with a notice without making one.
FURNITURE = """
please sorry oops we are re you your must need have to the a an this that our in it is was for or and of at by on be has had not now again back later soon site website page server browser click here home go return contact reload refresh view see read continue run use app application content text title temporarily currently today error status code message line file requested resource document url link time number some if nothing appears loading details full try moved deleted removed may been
view permission required requires service request cards reader paragraph works only with from its until then
この その お使いの ご利用の 当 本 こちらの ページ サイト ブラウザ を表示するには を閲覧するには をご覧になるには を利用するには してください して下さい です ます ください ました でした お手数ですが 申し訳ございませんが 申し訳ありません トップへ戻る トップページに戻る もう一度 再度 お試しください 現在 ただいま 大変 恐れ入りますが ご不便をおかけします 設定を変更 にして にする必要があります 情報 時間 お待ちください 予定です
bitte sie die der das diese dieser seite text um fortzufahren anzuzeigen und laden neu später noch einmal wird ist ihre in ihrem browser es ein fehler
veuillez le la les cette ce page pour continuer afficher contenu et recharger plus tard merci est votre dans navigateur une
请 您 的 此 该 本页 页面 网页 后 重新加载 继续 查看 内容 抱歉 返回首页 首页 稍后 您的浏览器 以
이 페이지를 보려면 사이트 다시 주세요 주십시오 죄송합니다 후 있습니다 브라우저에서 계속하려면 새로고침
"""

# Words of blind text that come in any order; a run of them is filler.
VOCABULARIES = {
    "filler": (
        "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat "
        "duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum "
        "vestibulum quisque pellentesque habitant morbi tristique senectus netus malesuada fames ac turpis egestas mauris vitae ultricies leo integer donec sagittis pretium vivamus lacinia odio praesent libero cursus ante dapibus diam nibh elementum imperdiet fusce nec tellus augue semper porta massa class aptent taciti sociosqu litora torquent per conubia nostra inceptos himenaeos curabitur sodales ligula dignissim tortor aenean quam scelerisque maecenas mattis convallis luctus viverra tincidunt eget risus faucibus blandit cras justo purus felis nunc orci posuere hendrerit nullam varius metus condimentum"
    ).split()
}

# What speaks of placeholders, or of notices, as such.
MENTIONS = {
    "placeholder": """
(template|templates|placeholder|placeholders|variable|variables|syntax|notation|brace|braces|bracket|brackets|literal|literally)
(explains|explained) (that|how|why)
(begins|began|starts|started|ends|ended) with
stands for
(platzhalter|vorlage|klammer|klammern|gabarit|accolade|accolades)
(記法|記号|変数|雛形|ひな形|ひな型|テンプレート|プレースホルダ|置き換|差し込み|括弧|占位符|模板|括号|변수|템플릿|괄호)
""",
    "notice": """
(called|mean|means|meant|printers|essay|dictionary|phrase|said|says|wrote|written|typed|quoted)
the (word|words|text|message|sign|note)
(sign|notice|note|which|that|it) (read|reads)
messages like
(hieß|schild|écrit|intitulé)
(と書|と呼|と記|という|といふ|と表示|と言|と云|と刷|と読め|と題|解説|説明し|随筆|貼り紙|看板|の札|所谓|写着|라고|라는)
""",
}


def expanded(pattern: str) -> Iterator[str]:
    """Every phrase that a pattern with alternatives stands for, inner groups first."""
    group = re.search(r"\(([^()]*)\)", pattern)
    if not group:
        yield pattern
        return
    for part in dict.fromkeys(group.group(1).split("|")):
        yield from expanded(pattern[: group.start()] + part + pattern[group.end() :])
