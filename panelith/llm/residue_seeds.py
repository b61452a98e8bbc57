"""Sample texts of residue, made from short phrase lists by rule; the models of residue are fitted on them.

The words below are fixed values: syntax of public template languages and wording of widely used web servers, frameworks,
languages and pages.
"""

from __future__ import annotations

import itertools
import random
from http import HTTPStatus

#: Field names as in mail merges and forms.
FIELDS = """name first_name last_name company address city state zip country phone email date time title amount price quantity number id user customer client
order invoice product url subject message description value text total currency party case court judge lawyer signature company_name start_date due_date
nome cognome indirizzo citta telefono data ora luogo importo firma oggetto numero cliente societa avvocato parte prezzo totale titolo data_nascita""".split()

#: Mustache and Jinja, Python, shell, ERB and JSP, Word, wiki and mail-merge forms, and how forms name what is to be filled in.
WRAPS = ["{{%s}}", "{{ %s }}", "{{page.%s}}", "{{{%s}}}", "{%s}", "{%% %s %%}", "${%s}", "${form.%s}", "#{%s}", "<%%= %s %%>", "<%% %s %%>", "[[%s]]", "%%(%s)s", "%%%%%s%%%%", "%%%s%%", "$%s$", "$%s", "<<%s>>", "<%s>", "«%s»", "[%s]", "[%%%s%%]",
         "[insert %s]", "[insert %s here]", "<insert %s>", "[enter %s]", "[your %s]", "[your %s here]", "[inserire %s]", "<inserire %s>", "[%s to be completed]", "[%s tbd]", "[completare %s]", "@@%s@@", "@%s@", "##%s##", "#%s#", "__%s__", "&lt;%s&gt;", "{{#%s}}", "{{/%s}}", "|%s|", "*|%s|*"]
POSITIONS = ["{%s}", "{{%s}}", "%%%s", "$%s", "${%s}", "[%s]"]

LITERALS = ["null null", "undefined undefined", "undefined", "[object Object]", "NaN NaN", "TODO TODO", "TBD", "FIXME", "XX/XX/XXXX", "dd/mm/yyyy", "gg/mm/aaaa", "Your Name Here", "Name Goes Here", "First Name Last Name", "Company Name Here", "Nome Cognome", "Nome Cognome Qui", "Insert Name", "MERGEFIELD Name"]

LOREM = """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud
exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur""".split()
MASH = "foo bar baz qux quux asdf asdfasdf qwer qwerty zxcv hjkl xxx yyy blah bla test test tst abc aaa".split()
REPEATED = ["sample text", "dummy text", "placeholder text", "filler text", "body text", "text here", "your text here", "text goes here", "insert text here", "test test test", "testo di prova", "testo di esempio", "testo segnaposto", "testo fittizio", "prova prova"]
FILLER = ["The quick brown fox jumps over the lazy dog.", "Ma la volpe col suo balzo ha raggiunto il quieto Fido.", "Text to follow.", "Text to come.", "Copy to follow.", "Content to be added.", "Content coming soon.", "Coming soon.", "Add your content here.", "Add your text here.", "Click to add text.", "Click here to enter text.", "Type your text here.", "Insert your text here.",
          "Heading goes here. Body text goes here.", "Replace this text with your own.", "Replace this paragraph with your own content.", "This is a placeholder.", "This is sample content.", "This is an example page.", "This is a test page. Please ignore.", "This is only a test. Please ignore.", "This page is intentionally left blank.", "This is dummy text used to check the layout.",
          "Draft, text to be supplied.", "(to be completed)", "(text to be supplied)", "To be written.", "Inserire qui il testo.", "Inserire il testo qui.", "Fare clic qui per immettere testo.", "Il testo seguirà.", "Segue testo.", "Testo da inserire.", "Testo da completare.", "(da completare)", "Contenuto in arrivo.", "Sostituire questo testo con il proprio.", "Questa è una pagina di prova. Ignorare.",
          "Questo è un testo di prova per verificare l'impaginazione.", "Pagina lasciata intenzionalmente vuota."]

ERRORS = ["The requested URL was not found on this server.", "The requested page could not be found.", "You don't have permission to access this resource.", "You do not have permission to view this page on this server.", "You are not authorized to view this page.", "You are not allowed to access this file.", "Permission denied.", "Access denied.", "Not authorised.",
          "The server encountered an internal error or misconfiguration and was unable to complete your request.", "Please contact the server administrator.", "The server is temporarily unable to service your request due to maintenance downtime or capacity problems. Please try again later.", "The server could not understand your request.",
          "The page you are looking for might have been removed, had its name changed, or is temporarily unavailable.", "The page you were looking for doesn't exist. You may have mistyped the address or the page may have moved.", "The document you are looking for has been moved.", "The file you requested no longer exists.", "Check the address and try again or use the search.", "Return to the home page.", "Go back to the index.",
          "We're sorry, but something went wrong.", "Sorry, something went wrong. Try again later.", "Oops, something went wrong while loading this page. Please reload the page in a few minutes.", "Oops! That page can't be found. It looks like nothing was found at this location. Maybe try a search?", "An error occurred while processing your request. Please try again later. Reference", "An unexpected error has occurred. Error code", "There has been a critical error on this website.", "Error establishing a database connection.",
          "Too many requests. Please slow down and try again later.", "You have sent too many requests from your address in a given amount of time. Wait 30 seconds before trying again.", "You are being rate limited. Wait a few seconds before asking again.", "Request timed out. Please try again.", "The connection has timed out.", "The connection was reset.", "This site can't be reached.",
          "Briefly unavailable for scheduled maintenance. Check back in a minute.", "Scheduled maintenance: the service is unavailable until 12:30. Thank you for your patience.", "The site is down for maintenance. We will be back soon.", "The service is temporarily unavailable. Planned outage until 9:15.", "Upgrade in progress. Thank you for your patience.",
          "Your session has expired. Please log in again to continue.", "Your session timed out. Sign in again to continue.", "You have been logged out. Please sign in again to continue reading.", "Your login is no longer valid.",
          "Traceback (most recent call last):\nFile \"main.py\", line 12, in main\nFile \"app.py\", line 87, in load\nKeyError: 'id'", "File \"<stdin>\", line 1, in <module>", "ValueError: 'name'", "TypeError: 'NoneType' object is not subscriptable", "TimeoutError: 'read'", "AttributeError: 'NoneType' object has no attribute 'text'", "IndexError: list index out of range",
          "Exception in thread \"main\" java.lang.NullPointerException\nat com.example.Main.main(Main.java:12)\nat com.example.App.run(App.java:44)", "java.lang.IllegalStateException", "java.lang.OutOfMemoryError: Java heap space", "java.io.IOException", "Caused by: java.sql.SQLException", "Server Error in '/' Application. Object reference not set to an instance of an object.",
          "Fatal error: Uncaught Error: Call to undefined function in index.php on line 12", "Fatal error: Allowed memory size exhausted in index.php on line 9", "Fatal error: Maximum execution time exceeded in index.inc on line 158", "Warning: could not connect to the database in index.php on line 12", "Exception: could not connect to the database in db.inc on line 7", "Parse error: syntax error, unexpected end of file in index.php on line 10", "Notice: Undefined index in page.inc on line 33",
          "Pagina non trovata.", "Impossibile trovare la pagina richiesta.", "La pagina richiesta non è disponibile.", "Il documento richiesto non esiste.", "Tornare alla pagina iniziale.", "Torna alla home page.", "Errore interno del server.", "Si è verificato un errore. Riprovare più tardi.", "Si è verificato un errore imprevisto. Contattare l'amministratore.", "Accesso negato. Non si dispone delle autorizzazioni necessarie.", "Non si dispone dell'autorizzazione per visualizzare questa pagina.",
          "Sessione scaduta. Effettuare nuovamente l'accesso per continuare.", "Servizio momentaneamente non disponibile.", "Il servizio non è al momento disponibile. Riprovare più tardi.", "Sito in manutenzione. Torneremo presto online.", "Manutenzione programmata: il servizio non è disponibile fino alle 12:30.", "Troppe richieste. Attendere e riprovare.", "Errore 404: pagina non trovata. Rif.", "Errore 500: servizio non disponibile. Riprovare più tardi. Codice", "Errore di connessione al database."]

SCRIPTS = ["JavaScript", "Javascript", "java script", "JS", "scripts", "scripting", "active scripting", "client-side scripts"]
SCRIPTS_IT = ["JavaScript", "JS", "gli script", "script", "gli script attivi"]
THINGS = ["this site", "this page", "this app", "this document", "the content", "the viewer", "this website", "this application", "the text"]
NOTICES = ["You need to enable {s} to run this app.", "You need to allow {s} to see {t}.", "Please enable {s} to view {t}.", "Please enable {s} in your browser to use {t}.", "Please turn {s} on and reload the page.", "Enable {s} and cookies to continue.", "{s} is not available.", "{s} is disabled in your browser.", "{s} is turned off.", "{s} seems to be disabled. Turn it on and reload to see {t}.", "{s} has been blocked. Change your settings and try again.",
           "We've detected that {s} is disabled in this browser. Please enable {s} or switch to a supported browser to continue using {t}.", "{t} requires {s} to be enabled.", "{t} requires {s}. Your browser has it turned off.", "{t} works best with {s} enabled.", "{t} works only with {s} enabled; reload once they are allowed.", "{t} can only be shown with {s} enabled.", "To use {t}, {s} must be allowed.", "Your browser does not support {s}.", "Your browser is blocking {s}.", "This browser is not running our {s}.",
           "Checking your browser before accessing {t}. Please turn on {s} and cookies.", "Loading {t} ... If nothing happens, enable {s}.", "Turn on {s} in your browser settings and try again.", "<noscript>You need to enable {s} to run this app.</noscript>", "<noscript>{t} needs {s}</noscript>", "Sorry, {t} does not work without {s}.", "If you see this message, your browser does not run {s}."]
NOTICES_IT = ["Per visualizzare questa pagina è necessario abilitare {s}.", "Per leggere il contenuto occorre abilitare {s} nel browser.", "Per continuare bisogna attivare {s} nel browser.", "Per proseguire bisogna consentire {s}.", "È necessario attivare {s} nel browser per utilizzare questa applicazione.", "Il tuo browser non supporta {s}.", "Il browser in uso blocca {s}.", "{s} è disattivato nel browser.", "{s} risulta disattivato. Attivarlo e ricaricare la pagina.", "Questo sito non funziona senza {s}.",
              "Attenzione: la pagina non funziona senza {s}. Abilitarli e ricaricare.", "Avviso: attivare {s} e ricaricare la pagina. Modificare le impostazioni.", "Questa pagina richiede {s}."]


def placeholders() -> list[str]:
    forms = lambda f: (f, f.replace("_", " "), f.title().replace("_", ""))
    return [w % x for w, f in itertools.product(WRAPS, FIELDS) for x in forms(f)] + [w % k for w in POSITIONS for k in range(10)] * 20


def literals() -> list[str]:
    return LITERALS * 20


def passages() -> list[str]:
    rng = random.Random(3)
    statuses = [x for x in HTTPStatus if x.value >= 400]
    out = ERRORS * 12
    out += [t % f"{x.value}{sep}{x.phrase}" for x in statuses for sep in (" ", ": ", " - ", ", ") for t in ("%s", "Error %s", "HTTP %s", "Status %s", "Errore %s", "HTTP Status %s", "Server error %s.")]
    out += [n.format(t=t, s=s) for n in NOTICES for t in THINGS for s in SCRIPTS]
    out += [n.format(s=s) for n in NOTICES_IT for s in SCRIPTS_IT] * 12
    out += [" ".join(rng.choices(LOREM, k=14)).capitalize() + "." for _ in range(900)]
    out += [" ".join(rng.choices(MASH, k=14)) for _ in range(400)]
    return out + [" ".join([r] * 6) for r in REPEATED] * 30 + FILLER * 40
