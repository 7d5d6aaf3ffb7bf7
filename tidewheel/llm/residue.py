"""Template residue, filler and error-page text: found by likelihood ratios of character n-grams, excluded by coverage.

Three models of characters are fitted, each an interpolation of n-grams up to ``ORDER``: residue (default and filler texts,
error and block messages, notices that scripts are needed), natural prose, and slots of templates.

* Residue starts from texts that ``SEEDS`` describes: a small grammar of what servers, browsers, editors and themes say in
  general, in many languages. It then learns from the corpus: pieces of titles that the first models call residue are
  added to it (self-training).
* Prose is fitted to the distinct pieces of titles, but for those that the seeds alone explain well (``CLAIM``, whatever
  the rest of the corpus holds) and those that the first models call residue. A piece counts once, however often it occurs.
* Slots are told by shape: letters are one class, digits another, runs are one character, so a slot of any length and any
  name has the same n-grams. Their model is built from the delimiters of template languages.

Where the log likelihood ratio of a window is high, the text is residue there; the whole body is a window, too. A title
is excluded if such windows cover its body (the title without a site's name of one word before or after it, or without
brackets around it), or if a window of it is likelier a slot than prose. N-grams are hashed into a fixed number of buckets, so the models have one size for any corpus.

Titles are first restored (wrong encodings) and brought to one form (look-alike characters).
"""

from __future__ import annotations

import random
import re
from functools import cache
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import cut
from tidewheel.llm.lookalike import consistent
from tidewheel.llm.mojibake import Detector, detector

ORDER = 5
BUCKETS = 1 << 20
#: Share of a body's letters and digits that residue must cover.
COVERAGE = 0.8
#: Characters of a window, the mean log ratio that it must exceed, and the log ratio that a whole body must exceed.
WINDOW, LEAST, WHOLE = 10, 0.5, -3.0
#: Mean log likelihood of a character from which the seeds alone explain a piece.
CLAIM = -2.2
#: Weight of the seeds' single letters and pairs in the prose model.
PRIOR = 0.3
#: Texts drawn of each line of the grammar.
DRAWN = 60
#: Characters that are worked on at a time; a longer text is worked on alone.
AT_ONCE = 2_000_000
#: What a window must reach in all to be a slot, and the characters of such windows, as shapes.
SLOT, SLOT_WINDOWS = 3.0, (3, 5, 8)

# A grammar of texts that stand where a title should be. A line is a message or the ways to put it; of
# (a|b) one is drawn, an empty part is left out, 0 is any number.
SEEDS = r"""lorem ipsum dolor sit amet(,|)( consectetur adipiscing elit|)(,|)( sed do eiusmod tempor incididunt ut labore et dolore magna aliqua|)
(ut enim ad minim veniam|quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat|duis aute irure dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur|excepteur sint occaecat cupidatat non proident|sunt in culpa qui officia deserunt mollit anim id est laborum)
(foo|bar|baz|qux|foobar)( foo| bar| baz|)( baz| qux|)
(test|testing|tests|asdf|qwerty|qwertz|xxx|xxxx|aaa|abc|blah|bla)( test| testing| asdf| asdf asdf| qwerty| xxx| xxxx| 0| 000| blah| bla|)( test| testing| asdf| xxx| blah|)
(null|none|nil|nan|n/a|undefined|unknown|not set|no value|empty|missing|object object|default|void)
(todo|tbd|fixme|tba|wip|draft)(:| -|)( title| page title| headline| add title| write headline| text|)
(untitled|unnamed|no title|nameless)( document| page| post| article| entry| item| project| file|)( 0|-0|)
(new|blank|empty|default|sample|dummy|test|example|demo|placeholder|temporary)( page| document| post| title| heading| headline| text| article| content| site| name|)( here| 0|)
(page|document|article|post|site|home page|content|section|block|product|item)( title| heading| headline| name| text)( here| goes here| placeholder|)
(insert|enter|add|type|write|edit|put|provide|replace with|set|choose)( your| a| the| this| page| site| post|)( title| headline| heading| text| name| content| page title| site name)( here| below|)
(your|the|a|my)( title| headline| heading| text| page title| site name| content| company name| name)( goes here| here| placeholder|)
(placeholder|dummy|filler|sample|example|default|demo|template|blind)( text| title| headline| heading| content| copy| page)( 0|)
(coming soon|under construction|this site is under construction|page under construction|site coming soon|just another site|hello world|welcome to our website|index of /|it works!|welcome page|home page|parked domain|this domain is for sale|domain parked)
(oops! |oops, |sorry, |sorry! |we're sorry, |uh oh! |)(the |this |that |your |)(requested |)(page|file|resource|document|article|content|item|url|address|site|link|post|product|file or directory)( you requested| you are looking for| you were looking for|)( was not found| not found| could not be found| cannot be found| can't be found| does not exist| doesn't exist| no longer exists| is not available| isn't available| is no longer available| unavailable| is missing| has been moved| has been deleted or moved| has been removed)( on this server| here|)
(oops! |sorry, |)we (can't|cannot|couldn't|could not|are unable to|were unable to)( find| locate| display| load| show| open| reach)( the| this| that| your|)( page| file| site| content| url| document)( you requested| you are looking for|)
(an |a |some |)(unexpected |unknown |internal |fatal |critical |serious |application |server |network |database |system |runtime |technical |)(error|problem|failure|exception)( occurred| has occurred| was encountered| happened|)( while processing your request| while loading this page| on the server| in this application| with this site|)
(internal |)(server|application|database|network|script|runtime|proxy|gateway|system|connection|configuration|service|dns)( error| failure| timeout| timed out| failed| unavailable| exception| offline)( in '/' application| on line 0| in 0|)
(something|that|things) (went wrong|didn't work|has gone wrong|broke)(, please try again later|. try again|)
(please |)(try again|come back|check back|reload|refresh|wait|retry)( later| soon| the page| in a moment| in a few minutes| shortly| this page|)
we(')re having (trouble|problems|issues|difficulty)( loading| opening| showing| displaying| finding)( this| the| that)( page| site| content)
(access|permission|request|connection|authorization|entry)( is| was| has been|)( denied| forbidden| refused| blocked| rejected| restricted| not allowed| not permitted| required)( by the server| on this server| for this resource|)
(bad|invalid|malformed|illegal|unsupported)( request| gateway| url| hostname| response| token| method| parameter)( - invalid hostname| - invalid url| - request too long|)
(you|your account|your ip address|your ip)( do not have| don't have| have no| are not authorized| are not allowed| lacks)( permission| access| rights|)( to view| to access| to see| to open| to use)( this page| this resource| this site| the requested page| this directory| on this server)
(sorry, |)(you have been|you are|your ip has been|your request has been|your request was|this request was|request|client|visitor)( blocked| banned| denied| rejected| flagged)(, reference 0|, id 0| by our security service| by security rules|)
(your |this |the |)(session|login|token|link|request|page)( has| is|)( expired| timed out| ended| invalid)(, please log in again|. please sign in|)
(unauthorized|forbidden|not authorized|login required|authentication required|sign in to continue|log in to continue|please log in|permission denied|access denied|not acceptable|not implemented|service unavailable|request timeout|too many requests|rate limit exceeded|quota exceeded|bandwidth limit exceeded|payload too large)
(the |this |our |)(site|website|page|service|server|system|store|blog|shop|app)( is| is currently| is temporarily|)( down| offline| unavailable| closed| under maintenance| down for maintenance| undergoing maintenance| not available| temporarily unavailable| unreachable| suspended| overloaded)(, we'll be back soon|, please come back later|)
(this |the |)(site|page|website|server|webpage|host)( can't be reached| cannot be reached| could not be reached| isn't working| is not working| took too long to respond| refused to connect| is not responding| cannot be displayed| did not respond)
(connection|request|operation|query|page load|script|gateway|server)( timed out| timeout| refused| reset| closed| aborted| failed| lost| interrupted| was reset)( by peer| by server|)
(error|problem|failed|unable|failure)( establishing a| connecting to| to connect to the| connecting to the| opening the)( database| server| database connection| database server| host| backend| upstream)
(database|mysql|sql|db|sqlstate[hy000])( connection|)( error| failed| refused| lost|: connection refused|: access denied for user)
(fatal|parse|syntax|type|reference|runtime|compile)( error)(: uncaught|: undefined| in|: call to undefined|: unexpected|: allowed memory size of 0 bytes exhausted)( exception| typeerror| error| function| variable| index| token|)( in /var/www/html/index.php on line 0| in /var/www/index.php:0| on line 0| at line 0|)
(warning|notice|deprecated|strict standards)(: undefined|: cannot|: missing|: division by|: invalid|: use of undefined)( variable $x| variable| index| array key| offset| argument| constant| zero| property)( on line 0| in /var/www/html/index.php on line 0|)
(traceback \(most recent call last\)|stack trace|call stack|unhandled exception|uncaught exception|null pointer exception|nullpointerexception|java.lang.nullpointerexception|segmentation fault|core dumped|typeerror: undefined is not a function|debug mode|exception in thread main)
(hold on|one moment|just a moment|please wait|please stand by|wait a moment|attention required|loading)(!|...|, please|)
(just a moment, |please wait, |one moment, |hold on, |please |)(checking|verifying|check|verify|confirm|confirming|validating|we are checking|we need to verify)( your browser| that you are human| you are human| you are not a robot| you are a human| your connection| if the site connection is secure| your identity)( before accessing| before you continue| before continuing| to continue| before proceeding|)
(are you|prove you are|confirm you are|verify you are)( a robot| human| not a robot| a human)(?|)
(captcha|security check|ddos protection|browser check|human verification|bot detection|security verification|complete the security check)( required| to access| to continue| by firewall|)
(please |you need to |you must |you have to |)(enable|turn on|activate|allow|switch on|unblock)( javascript| java script| scripts| scripting| js| cookies| javascript and cookies| cookies and javascript| scripts and cookies)( in your browser| to continue| to view this page| to use this site| to run this app| and reload| and reload the page| for this site| in order to continue|)
(javascript|java script|scripts|scripting|js|cookies|javascript and cookies)( is| are| must be| has to be| have to be| need to be| should be)( required| disabled| turned off| switched off| not enabled| enabled| switched on| turned on| blocked| needed| not supported| off)( in your browser| to continue| to view this page| for this site| - please enable it to proceed|)
(this |the |our |)(page|site|app|application|website|form|web app)( requires| needs| won't work without| will not work without| doesn't work properly without| does not work without| depends on)( javascript| scripts| cookies| javascript to run| javascript to work| javascript enabled| a modern browser| a newer browser)
(your |this |)(browser|device|web browser)( does not support| doesn't support| is blocking| has disabled| is too old for| cannot run)( javascript| scripts| cookies| this site| frames| html5|)
(your browser is|this browser is|your version is)( not supported| no longer supported| out of date| outdated| unsupported)
(die |diese |)(angeforderte |gewünschte |)(seite|datei|adresse|ressource|webseite|inhalt)( wurde| konnte| ist|)( nicht gefunden| nicht gefunden werden| nicht verfügbar| nicht vorhanden| nicht mehr verfügbar| existiert nicht| existiert nicht mehr| gelöscht| nicht erreichbar| verschoben)
(ein |es ist ein |)(interner |unerwarteter |unbekannter |schwerer |)(fehler|serverfehler|anwendungsfehler|datenbankfehler|systemfehler)( ist aufgetreten| aufgetreten| 0| auf dieser seite|)
(zugriff|zugang|anfrage|verbindung|berechtigung)( verweigert| nicht erlaubt| gesperrt| abgelehnt| fehlgeschlagen| erforderlich| wurde blockiert| unterbrochen)
(ihre |die |)(sitzung|anmeldung|verbindung)( ist abgelaufen| abgelaufen| ist beendet| wurde getrennt)
(die |diese |)(seite|website|server|dienst)( ist| ist derzeit| wird|)( in wartung| nicht erreichbar| vorübergehend nicht verfügbar| gewartet| im aufbau| überlastet| wegen wartungsarbeiten geschlossen)
(etwas ist schiefgelaufen|da ist etwas schiefgelaufen|bitte versuchen sie es später erneut|zu viele anfragen|ungültige anfrage|einen moment bitte|bitte warten|bitte bestätigen sie, dass sie ein mensch sind|ihr browser wird überprüft|wartungsarbeiten|anmeldung erforderlich)
(bitte |)(aktivieren|erlauben|schalten)( sie)( javascript| cookies| skripte| javascript und cookies)( in ihrem browser|, um fortzufahren|, um diese seite zu nutzen| ein|)
(diese |die |)(seite|website|anwendung|app)( benötigt| erfordert| braucht| funktioniert nicht ohne)( javascript| cookies| skripte| einen neueren browser)
(javascript|cookies|skripte|skript)( ist| sind| muss| müssen)( deaktiviert| ausgeschaltet| erforderlich| aktiviert sein| nicht aktiviert| blockiert| eingeschaltet werden)( in ihrem browser|)
(ihr |dieser |)browser (unterstützt kein javascript|unterstützt javascript nicht|wird nicht unterstützt|ist veraltet|blockiert skripte)
(unbenannt|ohne titel|kein titel|unbenanntes dokument|unbenannte seite|neues dokument|neue seite|leere seite|neuer beitrag|dokument ohne titel)( 0|)
(titel|überschrift|text|seitentitel|namen|platzhalter)( hier|)( einfügen| eingeben| eintragen| einsetzen| folgt| ergänzen)
(hier|bitte)( titel| überschrift| text| seitentitel| den titel)( einfügen| eingeben| eintragen)
(platzhalter|beispiel|muster|blind|dummy|test|füll)(text|titel|seite|überschrift)( 0|)
(la |cette |)(page|ressource|adresse|fichier|contenu|document)( demandée| que vous cherchez| recherchée|)( est introuvable| introuvable| n'existe pas| n'existe plus| n'a pas été trouvée| non trouvée| n'est pas disponible| n'est plus disponible| indisponible| a été supprimée| a été déplacée| inexistante)
(une |)(erreur|erreur interne|erreur inattendue|erreur fatale|erreur serveur|erreur de base de données|erreur d'application)( du serveur| s'est produite| est survenue| inconnue| 0| de connexion| technique|)
(accès|connexion|requête|demande|autorisation)( refusé| interdit| non autorisé| bloqué| limité| refusée| interrompue| bloquée| requise| expirée)
(votre |la |)(session|connexion|requête)( a expiré| est expirée| expirée| est terminée)
(le |ce |)(site|service|serveur|page)( est| est actuellement|)( en maintenance| en construction| indisponible| temporairement indisponible| hors ligne| inaccessible| fermé)
(oups ! |désolé, |)(quelque chose s'est mal passé|un problème est survenu|veuillez réessayer plus tard|veuillez patienter|un instant|trop de requêtes|requête incorrecte|vérification de votre navigateur|vérifiez que vous êtes humain|authentification requise)
(veuillez |vous devez |merci d'|il faut )(activer|autoriser|accepter|réactiver)( javascript| les cookies| les scripts| javascript et les cookies)( dans votre navigateur| pour continuer| pour afficher cette page| pour utiliser ce site|)
(ce |cette |)(site|page|application)( nécessite| requiert| a besoin de| exige| ne fonctionne pas sans)( javascript| javascript pour fonctionner| les cookies| l'activation de javascript| des scripts)
(javascript|les scripts|les cookies)( est| sont| doit être| doivent être)( désactivé| désactivés| requis| activé| activés| nécessaire| bloqués)( dans votre navigateur| pour continuer|)
(votre |)navigateur (ne prend pas en charge javascript|ne supporte pas javascript|n'est pas pris en charge|est obsolète|bloque les scripts)
(sans titre|document sans titre|page sans titre|sans nom|nouvelle page|nouveau document|page vide|aucun titre|titre manquant|titre par défaut)( 0|)
(titre|texte|nom|en-tête)( à compléter| à remplacer| à définir| à saisir| à insérer| à venir| ici)
(saisissez|insérez|entrez|ajoutez|insérer|ajouter|saisir|écrivez)( le| un| votre|)( titre| texte| nom)( ici| de la page|)
(texte|titre|contenu|page|faux texte)( de remplissage| d'exemple| de test| par défaut| provisoire| factice| fictif)( ici| 0|)
(la |esta |)(página|recurso|archivo|dirección|contenido)( solicitada| que busca|)( no se encuentra| no encontrada| no existe| no disponible| no está disponible| ya no existe| ya no está disponible| no se ha encontrado| no se pudo encontrar| ha sido eliminada| ha sido movida)
(se ha producido un |ha ocurrido un |un |)(error|error interno|error inesperado|error fatal|error de servidor|error de base de datos|error de aplicación)( del servidor| desconocido| 0| de conexión| al procesar su solicitud|)
(acceso|conexión|solicitud|permiso|petición)( denegado| prohibido| restringido| no autorizado| rechazada| bloqueada| bloqueado| denegada| incorrecta| interrumpida)
(su |la |)(sesión|conexión)( ha caducado| ha expirado| caducada| expirada| finalizada)
(el |este |)(sitio|servicio|servidor|página)( está|)( en mantenimiento| en construcción| no disponible| temporalmente fuera de servicio| caído| cerrado| fuera de línea)
(¡vaya! |lo sentimos, |)(algo salió mal|algo ha ido mal|inténtelo de nuevo más tarde|espere un momento|un momento|demasiadas solicitudes|verifique que es humano|comprobando su navegador|inicie sesión para continuar)
(active|activa|habilite|habilita|debe activar|debe habilitar|es necesario activar|es necesario habilitar|por favor, active|necesita activar)( javascript| las cookies| los scripts| javascript y las cookies)( en su navegador| en el navegador| para continuar| para ver esta página| para usar este sitio|)
(este |esta |)(sitio|página|aplicación)( requiere| necesita| no funciona sin)( javascript| javascript para funcionar| cookies| scripts)
(javascript|las cookies|los scripts)( está| están| debe estar| deben estar)( desactivado| deshabilitado| activado| bloqueados| desactivadas| habilitado)( en su navegador|)
(su |el |)navegador (no admite javascript|no soporta javascript|no es compatible|está desactualizado|bloquea los scripts)
(sin título|documento sin título|página sin título|sin nombre|nueva página|nuevo documento|página en blanco|título pendiente|título por defecto)( 0|)
(escriba|inserte|introduzca|añada|escribe|inserta|ingrese|agregue)( aquí|)( el| un| su|)( título| texto| nombre| título de la página)( aquí|)
(texto|título|contenido|página)( de relleno| de ejemplo| de prueba| provisional| por defecto| de muestra| ficticio)( aquí| 0| 0|)
(страница|запрошенная страница|эта страница|такая страница|файл|документ|ресурс|такой страницы)( не найдена| не найден| не существует| недоступна| больше не существует| удалена| была удалена или перемещена| отсутствует| временно недоступна| нет)( на сервере| на этом сервере|)
(произошла |возникла |)(ошибка|внутренняя ошибка|непредвиденная ошибка|неизвестная ошибка|критическая ошибка|ошибка сервера|ошибка базы данных|ошибка приложения)( сервера| 0| при обработке запроса| соединения| подключения|)
(доступ|вход|запрос|доступ к странице)( запрещён| запрещен| закрыт| ограничен| заблокирован| отклонён| невозможен)
(сеанс|время сеанса|сессия|ваша сессия|срок действия сессии)( истёк| истек| истекла| завершён| завершена| истекло)
(сайт|сервис|сервер|страница)( на обслуживании| в разработке| недоступен| временно недоступен| не отвечает| закрыт на техническое обслуживание| находится в разработке)
(что-то пошло не так|попробуйте позже|повторите попытку позже|подождите|пожалуйста, подождите|слишком много запросов|неверный запрос|проверка браузера|подтвердите, что вы не робот|технические работы|соединение прервано|время ожидания истекло|требуется авторизация)
(пожалуйста, |необходимо |вам нужно |)(включите|включить|разрешите|активируйте)( javascript| скрипты| cookies| куки| javascript и cookies)( в браузере| в вашем браузере|, чтобы продолжить| для продолжения|)
(для работы |для просмотра |этому |этот )(сайта|сайту|страницы|сайт)( нужен| требуется| необходим| требует)( javascript| включённый javascript| скрипты)
(javascript|скрипты|cookies)( отключён| отключены| отключен| выключен| заблокированы| не поддерживается| должен быть включён)( в вашем браузере|)
(ваш |)браузер (не поддерживает javascript|не поддерживается|устарел|блокирует скрипты)
(без названия|без заголовка|без имени|документ без названия|новая страница|новый документ|пустая страница|страница без названия|нет заголовка)( 0|)
(введите|вставьте|добавьте|укажите|напишите|впишите)( здесь|)( заголовок| название| текст| имя)( страницы| здесь|)
(заголовок|название|текст)( страницы| сайта| по умолчанию| здесь|)
(пример|образец|заглушка|рыба|заполнитель|тестовый)( текста| заголовка| текст| страницы|)
(a |esta |)(página|arquivo|ficheiro|recurso|conteúdo)( solicitada|)( não encontrada| não foi encontrada| não existe| não está disponível| indisponível| não encontrado| removida)
(ocorreu um |)(erro|erro interno|erro inesperado)( do servidor| 0| desconhecido| de conexão|)
(acesso|conexão|pedido|sessão)( negado| recusado| proibido| recusada| bloqueado| expirada| restrito)
(ative|ativar|habilite|por favor, ative|é necessário ativar)( o javascript| os cookies| o javascript no navegador)( para continuar| para ver esta página|)
(sem título|documento sem título|página sem título|nova página|insira o título aqui|título aqui|texto de exemplo|algo deu errado|site em manutenção|serviço indisponível|tente novamente mais tarde|este site requer javascript|seu navegador não suporta javascript)
(la |questa |)(pagina|risorsa|file)( richiesta|)( non trovata| non esiste| non è disponibile| non è stata trovata| inesistente| rimossa)
(errore|errore interno|si è verificato un errore|errore imprevisto)( del server| 0| sconosciuto|)
(accesso negato|accesso vietato|sessione scaduta|servizio non disponibile|sito in manutenzione|qualcosa è andato storto|riprova più tardi|abilita javascript|attiva javascript per continuare|questo sito richiede javascript|senza titolo|documento senza titolo|nuova pagina|inserisci il titolo qui|testo segnaposto|testo di esempio|titolo qui)
(de |deze |)(pagina)( niet gevonden| bestaat niet| is niet beschikbaar| kon niet worden gevonden)
(toegang geweigerd|interne serverfout|er is een fout opgetreden|sessie verlopen|schakel javascript in|deze site vereist javascript|zonder titel|naamloos document|nieuwe pagina|voer hier een titel in|voorbeeldtekst|er ging iets mis)
(nie znaleziono strony|strona nie istnieje|strona niedostępna|odmowa dostępu|brak dostępu|błąd serwera|wewnętrzny błąd serwera|wystąpił błąd|sesja wygasła|włącz javascript|ta strona wymaga javascript|bez tytułu|nowa strona|wpisz tytuł|tekst zastępczy|coś poszło nie tak)
(sidan hittades inte|åtkomst nekad|ett fel har inträffat|internt serverfel|aktivera javascript|namnlös|utan titel|ny sida|platshållartext|sayfa bulunamadı|erişim engellendi|erişim reddedildi|bir hata oluştu|sunucu hatası|javascript'i etkinleştirin|başlıksız|adsız belge|yeni sayfa|başlık buraya|örnek metin)
(η |αυτή η |)σελίδα( που ζητήσατε|)( δεν βρέθηκε| δεν υπάρχει| δεν είναι διαθέσιμη| δεν είναι πλέον διαθέσιμη)
(σφάλμα|εσωτερικό σφάλμα|παρουσιάστηκε σφάλμα|προέκυψε σφάλμα)( διακομιστή| 0| σύνδεσης|)
(δεν επιτρέπεται η πρόσβαση|άρνηση πρόσβασης|η πρόσβαση απορρίφθηκε|απαγορεύεται η πρόσβαση|η συνεδρία έληξε|κάτι πήγε στραβά|δοκιμάστε ξανά αργότερα|ενεργοποιήστε τη javascript|ενεργοποιήστε τη javascript για να συνεχίσετε|απαιτείται javascript|ο περιηγητής σας δεν υποστηρίζει javascript|χωρίς τίτλο|έγγραφο χωρίς τίτλο|νέα σελίδα|εισάγετε τίτλο|τίτλος σελίδας|δοκιμαστικό κείμενο|υπό κατασκευή)
(お探しの|ご指定の|この|要求された|)(ページ|ファイル|コンテンツ)(が|は)(見つかりません|見つかりませんでした|存在しません|利用できません|表示できません|削除されました)
(エラー|サーバーエラー|内部サーバーエラー|内部エラー|予期しないエラー|データベースエラー|アプリケーションエラー)(が発生しました|です| 0|)
(アクセス|接続|リクエスト)(が拒否されました|できません|は禁止されています|がブロックされました|がタイムアウトしました|拒否)
(javascript|cookie|スクリプト)(を有効にしてください|が無効です|が必要です|を有効にして再読み込みしてください|を許可してください|が無効になっています)
(無題|無題のドキュメント|無題のページ|タイトルなし|名称未設定|新しいページ|新規ドキュメント|準備中|工事中|メンテナンス中|しばらくお待ちください|ダミーテキスト|ダミー|サンプルテキスト|サンプルページ|テスト|テストページ|仮タイトル|セッションの有効期限が切れました)
(ここに|)(タイトル|見出し|テキスト|名前)(を入力|を入力してください|を挿入|が入ります|を追加)
(요청하신 |)(페이지|파일)(를|을) 찾을 수 없습니다
(접근이 거부되었습니다|접근 권한이 없습니다|액세스가 거부되었습니다|오류가 발생했습니다|서버 오류|내부 서버 오류|오류 0|서비스 점검 중입니다|점검 중입니다|페이지가 존재하지 않습니다|세션이 만료되었습니다|잠시만 기다려 주세요|잠시 후 다시 시도해 주세요)
(javascript|자바스크립트|쿠키)(를 활성화하세요|를 활성화해 주세요|를 사용하도록 설정하세요|가 필요합니다|가 비활성화되어 있습니다)
(제목 없음|무제|이름 없음|새 페이지|새 문서|제목을 입력하세요|여기에 제목을 입력하세요|샘플 텍스트|예시 텍스트|더미 텍스트|테스트 페이지|준비 중입니다)
(页面未找到|找不到页面|页面不存在|找不到网页|该页面不存在|拒绝访问|访问被拒绝|禁止访问|服务器错误|内部服务器错误|发生错误|出错了|会话已过期|网站维护中|请启用javascript|请开启javascript|需要启用javascript|无标题|未命名文档|未命名|新建页面|请输入标题|在此输入标题|示例文本|占位文本|测试页面|请稍候)"""
# How template languages set off a slot, and the shapes that its name has (a: letters).
DELIMITERS = ("{{ @ }}", "{{@}}", "{{{@}}}", "{{#a @}}", "{{ @ | a }}", "{@}", "${@}", "${{ @ }}", "${{ @ | a }}", "#{@}", "<%= @ %>", "<%=@%>", "<% @ %>", "<?= $@ ?>", "<?a a $@ ?>", "<?a a $@; ?>", "[[@]]", "[%@%]", "[% @ %]", "%%@%%", "__@__", "{% @ %}", "{% a @ %}", "@a.@", "$@$", '<!--#a a="@" -->', "<!-- @ -->", "<<@>>", "%(@)s", "{{@ | a: 0}}", "<@>", "{@:a}")
SHAPES = ("a", "a.a", "a_a", "a.a.a", "a_a_a", "a-a", "a0", "a a", "a.a_a", "a->a", "a['a']", "a::a")
BARE_SLOTS = ("%s", "%d", "%s a", "%s - %s", "%s | %s", "%0$s", "%0$s - %0$s", "{0}", "{0} - {0}", "{0} | {0}", "{0} a", "[a a]: {0}", "{}")
# Shapes of natural titles that hold the same signs.
PLAIN_SHAPES = ("a", "a a", "a a a a", "a, a a", "a: a a", "a - a", "a | a", "a 0", "a 0 - 0", "a (a a)", "(a) a", "[a] a a", "a [a 0]", "{0, 0, 0}: a", "a {a, a} a", "a {0, 0}", "$0 a", "a $0", "0% a", "a 0% a a", "a 0 %", "a #0", "#a a", "@a a", "a @a", "a@a.a", "a & a", "a's a", "\"a a\" a", "a <0 a", "a > a", "a < a", "a/a", "a_a", "a.a", "a.a 0.0", "a * a", "a +0", "a = a", "a: <a> a a", "the <a> a a a")

_SEPARATOR = re.compile(r"\s+(?:[|–—\-]|::)\s+|:\s+")
_SIGN = re.compile(r"[{}<>%$\[\]@#_]")
_LETTERS, _DIGITS = re.compile(r"[^\W\d_]+"), re.compile(r"\d+")
_GROUP = re.compile(r"\(((?:\\.|[^()\\])*)\)|((?:\\.|[^()\\])+)")
_PLAIN = str.maketrans("0123456789’", "0000000000'")
_STOPS = ".!… "


def drawn(line: str, size: int = DRAWN) -> list[str]:
    """Texts of a line of the grammar: all of them if they are few, else ``size`` drawn evenly, always the same."""
    groups = [[re.sub(r"\\(.)", r"\1", p) for p in (m.group(1).split("|") if m.group(1) is not None else [m.group(2)])] for m in _GROUP.finditer(line)]
    rnd, decks, out = random.Random(line), [[] for _ in groups], []
    total = 1
    for g in groups:
        total *= len(g)
    for _ in range(min(size, 4 * total)):
        for g, deck in zip(groups, decks):  # each part comes up equally often
            if not deck:
                deck += g
                rnd.shuffle(deck)
        out.append("".join(deck.pop() for deck in decks))
    return list(dict.fromkeys(out))


@cache
def families() -> tuple[tuple[str, ...], ...]:
    """The seed texts, by line of the grammar; the last one holds each HTTP status with its phrase in the usual forms."""
    status = []
    for s in HTTPStatus:
        if s >= 400:
            p = s.phrase.lower()
            status += [f"000 {p}", f"000 - {p}", f"error 000 {p}", f"http status 000 – {p}", f"error 000: {p}", p]
    status += ["http error 000", "error code 000", "000 error", "error 000", "http 000", "status 000", "code 000", "000 page", "000", "fehler 000", "erreur 000", "ошибка 000", "σφάλμα 000", "erro 000", "errore 000", "fout 000", "błąd 000"]
    return (*(tuple(drawn(x)) for x in SEEDS.split("\n")), tuple(status))


def slots() -> list[str]:
    """All texts of the slot model: each shape in each kind of slot, alone and in a text."""
    own = [d[: d.rindex("@")] + n + d[d.rindex("@") + 1 :] for d in DELIMITERS for n in SHAPES] + list(BARE_SLOTS)
    return [shaped(f(s)) for s in own for f in (str, lambda s: f"a {s}", lambda s: f"{s} a")]


def folded(text: str) -> str:
    """Lower case, single spaces, every digit 0, straight apostrophes; no full stop at the end, no word twice in a row."""
    words = text.lower().translate(_PLAIN).split()
    return " ".join(w for w, before in zip(words, ["", *words]) if w != before).rstrip(_STOPS)


def shaped(text: str) -> str:
    """The shape of a folded text: each run of letters is ``a``, each run of digits ``0``."""
    return _LETTERS.sub("a", _DIGITS.sub("0", text))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of many folded texts with their ends marked: the bucket of the n-gram that ends at each character, by order; each
    character's place in its text, the number of its text, and its code."""
    padded = [f"\x02{t}\x03" for t in texts]
    sizes = np.array([len(p) for p in padded], np.int64)
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(padded)), sizes)
    inner = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((ORDER + 1, len(code)), np.int32)
    h = np.full(len(code), 0x811C9DC5, np.uint32)
    for k in range(1, ORDER + 1):
        back = np.full(len(code), 2, np.uint32)  # what is before the beginning
        back[k - 1 :] = np.where(inner[k - 1 :] >= k - 1, code[: max(0, len(code) - k + 1)], 2)
        h = (h ^ back) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out[k] = (h + np.uint32(k * 0x3C6EF35)) & np.uint32(BUCKETS - 1)
    return out, inner, of, code


def counts_of(texts: list[str], weights: list[float] | None = None, order: int = ORDER) -> np.ndarray:
    """N-gram counts of folded texts, all orders up to ``order`` in one array of ``BUCKETS``; none of no texts."""
    out, done = np.zeros(BUCKETS, np.float32), 0
    for part in _sliced(texts):
        grams, _, of, _ = _grams(part)
        w = None if weights is None else np.asarray(weights[done : done + len(part)])[of]
        for k in range(1, order + 1):
            out += np.bincount(grams[k], weights=w, minlength=BUCKETS)
        done += len(part)
    return out


class Ratio:
    """Log likelihood ratios of one model of characters against another. Each is an interpolation of its n-grams: a context
    that was seen often is trusted more, an unseen one falls back on a shorter one."""

    def __init__(self, for_: np.ndarray, against: np.ndarray, bound: float = 4.0, prior: np.ndarray | None = None):
        """``prior``: counts of single characters and pairs that are added to those of the second model."""
        total = float(against.sum()) / ORDER
        if prior is not None:
            against, total = against + prior, total + float(prior.sum()) / 2
        self.models = (for_, float(for_.sum()) / ORDER), (against, total)
        self.bound = bound

    @staticmethod
    def _logs(grams: np.ndarray, counts: np.ndarray, total: float) -> list[np.ndarray]:
        """Log likelihood of each character after no, one, two ... characters before it."""
        # a character never seen is as likely in any model: a hundredth of all goes to such ones
        n = counts[grams[1]]
        p, out = 0.99 * n / max(total, 1e-9) + 0.01 / 3000, []
        for k in range(1, ORDER + 1):
            if k > 1:
                n, before = counts[grams[k]], np.roll(n, 1)
                p = (n + p) / (np.maximum(before, n) + 1)
            out.append(np.log(p))
        return out

    def likelihood(self, texts: list[str]) -> np.ndarray:
        """Mean log likelihood of the characters of each text under the first model alone."""
        out = []
        for part in _sliced(texts):
            grams, inner, of, _ = _grams(part)
            keep = inner > 0
            logs = self._logs(grams, *self.models[0])[-1][keep]
            out.append(np.bincount(of[keep], weights=logs, minlength=len(part)) / np.maximum(1, np.bincount(of[keep], minlength=len(part))))
        return np.concatenate(out) if out else np.zeros(0)

    def windows(self, texts: list[str], *sizes: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
        """(log ratio of each whole text with its beginning and end; for each size the log ratio and the width of the window
        that begins at each character; where each text begins; the characters; the running sum of their ratios). A text's end is a character.

        A window is a text of its own: its first character has no context, its second one character, and so on.
        """
        grams, inner, of, code = _grams(texts)
        keep = inner > 0
        logs = [np.clip(a - b, -self.bound, self.bound)[keep] for a, b in zip(self._logs(grams, *self.models[0]), self._logs(grams, *self.models[1]))]
        of = of[keep]
        length = np.bincount(of, minlength=len(texts))
        ends = np.cumsum(length)
        n = len(of)
        at, total, found = np.arange(n), np.concatenate([[0.0], np.cumsum(logs[-1])]), []
        for size in sizes:
            width = np.minimum(size, ends[of] - at)
            ratio = np.where(width >= ORDER, total[at + width] - total[np.minimum(at + ORDER - 1, n)], 0.0)
            for k in range(ORDER - 1):
                ratio += np.where(width > k, logs[k][np.minimum(at + k, n - 1)], 0.0)
            found.append((ratio, width))
        return np.bincount(of, weights=logs[-1], minlength=len(texts)), found, ends - length, code[keep], total


class Ratios:
    """Residue and slots against prose. ``prose``, ``residue``: n-gram counts learned from the corpus, beside the seeds'."""

    def __init__(self, prose: np.ndarray, residue: np.ndarray, prose_shapes: np.ndarray, seeds: np.ndarray | None = None):
        # single letters and pairs speak for neither: prose has those of the seeds, which matters where a corpus is small
        self.residue = Ratio((seed_counts() if seeds is None else seeds) + residue, prose, prior=PRIOR * seed_counts(order=2))
        plain = plain_counts()
        self.slot = Ratio(slot_counts(), prose_shapes + plain * max(1.0, 0.1 * float(prose_shapes.sum() / plain.sum())), bound=3.0)

    def _scan(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(share that is residue; running sum of log ratios by character; where each text begins in it)."""
        whole, ((ratio, width),), begin, code, total = self.residue.windows(texts, WINDOW)
        length = np.diff(np.append(begin, len(ratio)))
        of = np.repeat(np.arange(len(texts)), length)
        # a narrower window, at a text's end, counts only if it is the text's only one
        room = np.repeat(begin + length, length) - np.arange(len(ratio))
        good = np.flatnonzero((ratio > LEAST * width) & ((room >= WINDOW) | (length[of] == width)))
        steps = np.bincount(good, minlength=len(ratio) + 1) - np.bincount(good + width[good], minlength=len(ratio) + 1)
        said = _alnum()[code]
        size = np.bincount(of, weights=said, minlength=len(texts))
        share = np.bincount(of, weights=said & (np.cumsum(steps[:-1]) > 0), minlength=len(texts)) / np.maximum(1, size)
        return np.where((whole > WHOLE) & (size > 0), 1.0, share), total, begin

    def covered(self, texts: list[str]) -> np.ndarray:
        """Share of each folded text's letters and digits that are residue; 0 where it has none."""
        return np.concatenate([self._scan(part)[0] for part in _sliced(texts)]) if texts else np.zeros(0)

    def has_slot(self, texts: list[str]) -> np.ndarray:
        """Of folded texts, whether a window of each is likelier a slot than prose, by ``SLOT`` in all."""
        out = np.zeros(len(texts), bool)
        at = np.array([i for i, t in enumerate(texts) if _SIGN.search(t)], np.int64)
        done = 0
        for part in _sliced([shaped(texts[i]) for i in at]):
            _, found, begin, _, _ = self.slot.windows(part, *SLOT_WINDOWS)
            best = np.maximum.reduce([np.maximum.reduceat(np.where(width > 1, ratio, -np.inf), begin) for ratio, width in found])
            out[at[done : done + len(part)]] = best > SLOT
            done += len(part)
        return out

    def told(self, texts: list[str]) -> np.ndarray:
        """Of folded texts, whether each holds a slot, or its body is residue; false for the empty text."""
        out, pairs, done = self.has_slot(texts), [], 0
        for part in _sliced(texts):
            share, total, begin = self._scan(part)
            for i, t in enumerate(part):
                if share[i] >= COVERAGE:
                    out[done + i] = True
                elif not out[done + i]:
                    # a part far likelier prose than residue is no body, whatever its ends tell
                    pairs += [(done + i, t[a:b]) for a, b in _bodies(t) if total[begin[i] + b] - total[begin[i] + a] > -3 * self.residue.bound]
            done += len(part)
        if pairs:
            hit = self.covered([body for _, body in pairs]) >= COVERAGE
            out[[i for (i, _), h in zip(pairs, hit) if h]] = True
        return out


@cache
def _alnum() -> np.ndarray:
    return np.array([chr(c).isalnum() for c in range(0x110000)], bool)


def _sliced(texts: list[str]):
    """The texts in parts of about ``AT_ONCE`` characters."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > AT_ONCE:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t) + 2
    if part:
        yield part


def _bodies(text: str) -> list[tuple[int, int]]:
    """Where a folded text is without a site's name (one word, perhaps with a sign) before it, after it or both, or without
    the brackets around it."""
    cuts = list(_SEPARATOR.finditer(text))
    if not cuts:
        return [(1, len(text) - 1)] if text[:1] + text[-1:] in ("[]", "<>", "()", "{}") and len(text) > 2 else []
    first, last = cuts[0], cuts[-1]
    name = lambda part: part.count(" ") == 0 and any(c.isalpha() for c in part)
    lead, tail = name(text[: first.start()]), name(text[last.end() :])
    out = [(first.end(), len(text))] if lead else []
    out += [(0, last.start())] if tail else []
    out += [(first.end(), last.start())] if lead and tail else []
    return [(a, e) for a, b in out if (e := a + len(text[a:b].rstrip(_STOPS))) > a]


@cache
def seed_counts(left_out: int = -1, order: int = ORDER) -> np.ndarray:
    """Counts of the seed texts; each line of the grammar weighs alike. ``left_out``: a line to do without, for tests."""
    texts, weights = [], []
    for i, own in enumerate(families()):
        if i != left_out:
            texts += [folded(t) for t in own]
            weights += [min(1.0, 20 / len(own))] * len(own)
    return counts_of(texts, weights, order)


@cache
def slot_counts() -> np.ndarray:
    return counts_of(slots())


@cache
def plain_counts() -> np.ndarray:
    return counts_of([s for s in PLAIN_SHAPES for _ in range(20)])


def pieces(text: str) -> list[str]:
    """A folded text cut at its separators, without full stops."""
    return [p for x in _SEPARATOR.split(text) if (p := x.rstrip(_STOPS))]


def learn_once(distinct: list[str], known: Ratio, first: Ratios | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(prose, residue) counts of distinct pieces: by the seeds alone, or by the ``first`` models as well."""
    if not distinct:
        return np.zeros(BUCKETS, np.float32), np.zeros(BUCKETS, np.float32)
    prose = known.likelihood(distinct) < CLAIM
    if first is None:
        return counts_of([p for p, ok in zip(distinct, prose) if ok]), np.zeros(BUCKETS, np.float32)
    share = first.covered(distinct)
    spoken = [p for p, ok in zip(distinct, prose & (share < COVERAGE)) if ok]
    found = [p for p, x in zip(distinct, share) if x >= 0.9 and sum(c.isalpha() for c in p) >= 3]
    return counts_of(spoken), counts_of(found, [0.5] * len(found))


def learn_shapes(distinct: list[str], seeds: Ratios) -> np.ndarray:
    """Counts of distinct shapes, but for those that hold a slot by the shapes known beforehand."""
    return counts_of([s for s, slot in zip(distinct, seeds.has_slot(distinct)) if not slot]) if distinct else np.zeros(BUCKETS, np.float32)


def _nothing() -> np.ndarray:
    return np.zeros(BUCKETS, np.float32)


_BLOCK = 4096


def _summed(frame: DataFrame, count, models: int) -> list[np.ndarray]:
    """``count`` (distinct texts -> arrays of ``BUCKETS``) summed over the texts of a frame of one column.

    A task sends the buckets that it used, once; they are summed by block, and come to the driver as whole blocks: ``BUCKETS``
    numbers a model, whatever the corpus.
    """

    def work(batches):
        total = [_nothing() for _ in range(models)]
        for b in batches:
            for t, n in zip(total, count(b.column(0).to_pylist())):
                t += n
        for m, t in enumerate(total):
            used = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), m, np.int32)), pa.array((used // _BLOCK).astype(np.int32)), pa.array(used.astype(np.int32)), pa.array(t[used])], names=["m", "block", "b", "n"])

    def pack(batches):
        blocks: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            m, block, bucket, n = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for key in np.unique(m.astype(np.int64) * BUCKETS + block):
                at = (m.astype(np.int64) * BUCKETS + block) == key
                out = blocks.setdefault((int(key // BUCKETS), int(key % BUCKETS)), np.zeros(_BLOCK))
                np.add.at(out, bucket[at] % _BLOCK, n[at])
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in blocks], pa.int32()), pa.array([k[1] for k in blocks], pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in blocks.values()], pa.binary())], names=["m", "block", "n"])

    out = [_nothing() for _ in range(models)]
    for r in frame.mapInArrow(work, "m int, block int, b int, n float").repartition("m", "block").mapInArrow(pack, "m int, block int, n binary").toLocalIterator():
        out[r["m"]][r["block"] * _BLOCK : (r["block"] + 1) * _BLOCK] += np.frombuffer(r["n"], np.float32)
    return out


def learn(frame: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prose, residue, prose shapes): n-gram counts learned from all texts of (``form``), for :class:`Ratios`.

    Forms are cut into pieces, made distinct by batch and by one exchange, and written; two passes over the pieces follow,
    and one over their distinct shapes. Null, empty and blank texts count for nothing.
    """
    spark = frame.sparkSession
    parts = max(frame.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)

    def split(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({p for t in b.column(0).unique().to_pylist() for p in pieces(t)}), pa.string())], names=["piece"])

    def shapes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(sorted({shaped(p) for p in b.column(0).to_pylist()}), pa.string())], names=["shape"])

    distinct = cut(frame.where(F.col("form").isNotNull()).select("form").mapInArrow(split, "piece string").repartition(parts, "piece").distinct())
    known = lambda: Ratio(seed_counts(), _nothing())
    (prose, _) = _summed(distinct, lambda texts: learn_once(texts, known()), 2)
    (plain,) = _summed(distinct.mapInArrow(shapes, "shape string").distinct(), lambda texts: (learn_shapes(texts, Ratios(_nothing(), _nothing(), _nothing())),), 1)
    first = spark.sparkContext.broadcast((prose, plain))
    (prose, residue) = _summed(distinct, lambda texts: learn_once(texts, known(), Ratios(first.value[0], _nothing(), first.value[1])), 2)
    return prose, residue, plain


_MODELS: dict[int, Ratios] = {}


def _model(shared) -> Ratios:
    """One set of models a worker process and broadcast."""
    key = shared.id if hasattr(shared, "id") else id(shared)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Ratios(*shared.value)
    return _MODELS[key]


def plain_form(text: str, garbled: Detector) -> str:
    """A title restored, in one spelling, folded."""
    if not text.isascii() or "+" in text or "&" in text:
        text = consistent(garbled.repair(text)[1])[1]
    return folded(text)


def told(texts: list[str], ratios: Ratios, garbled: Detector) -> list[bool]:
    """Of each title whether it is residue; disguised and garbled ones are seen through."""
    return ratios.told([plain_form(t, garbled) for t in texts]).tolist()


def plain_forms(df: DataFrame, keys: list[str], shared_tokens) -> DataFrame:
    """``keys`` and ``form`` of each row of (keys, ``text``), written once: both the models and their use read it. Null stays null."""
    picked = df.select(*[F.col(f"`{k}`") for k in keys], F.col("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])

    def work(batches):
        garbled = detector(shared_tokens)
        for b in batches:
            coded = b.column(len(keys)).dictionary_encode()
            forms = pa.array([plain_form(t, garbled) for t in coded.dictionary.to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), forms.take(coded.indices)], names=[*keys, "form"])

    return cut(picked.mapInArrow(work, f"{kinds}, form string"))


def mark_residue(df: DataFrame, keys: list[str], shared_tokens, found: bool = True) -> DataFrame:
    """``keys`` of each row of (keys, ``text``) that is to be kept out, or with ``found=False`` of each that stays.

    Null, empty and blank texts are no residue. Equal rows are told alike; columns beside ``keys`` and ``text`` do not
    matter; a table without rows gives none. Narrow but for what :func:`learn` exchanges. ``shared_tokens``: broadcast
    corpus tokens, so that garbled titles are seen through.
    """
    forms = plain_forms(df, keys, shared_tokens)
    shared = df.sparkSession.sparkContext.broadcast(learn(forms))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in forms.schema.fields[:-1])

    def work(batches):
        ratios = _model(shared)
        for b in batches:
            coded = b.column(len(keys)).dictionary_encode()
            done = np.append(ratios.told(coded.dictionary.to_pylist()), False)
            marked = done[coded.indices.fill_null(len(done) - 1).to_numpy(zero_copy_only=False)]
            take = pa.array(np.flatnonzero(marked == found), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(take) for i in range(len(keys))], names=keys)

    return (forms.where(F.col("form").isNotNull()) if found else forms).mapInArrow(work, kinds)
