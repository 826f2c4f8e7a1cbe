"""The labelled table the personal-data model is trained from: carrier lines with typed slots, and how slots are filled."""

from __future__ import annotations

import random
import re

# Frequent given names of several countries (a feature of the model and fillers of the name slot).
GIVEN = (
    "Adam Alex Alice Amelia Amy Ana Andrea Andrew Anna Anne Anouk Anton Antonio Arne Arthur Barbara Beatriz Ben Bianca Bram Bruno Camille Carla Carlos Carmen Caroline Catarina Charles Charlotte Chiara Chloe Christian Clara Claudia "
    "Cristina Daan Daniel David Diana Diego Dirk Edward Elena Elisa Elise Emil Emilia Emma Eric Erik Erika Eva Fabio Felix Femke Fernando Finn Florian Francesca Francisco Frank Frida Gabriel Georg George Giovanni Giulia Greta Hanna "
    "Hannah Hans Harry Helen Helena Henrik Hugo Ida Ines Irene Isabel Ivan Jack Jakob James Jan Jana Jean Joana Johanna John Jonas Jorge Joseph José João Judith Julia Julie Karin Karl Katharina Katja Lars Laura Lea Lena Leo Leon Liam "
    "Linda Lisa Lotte Luca Lucas Lucia Luis Lukas Magdalena Manuel Mara Marc Marco Maria Marie Mario Mark Marta Martin Mateus Mathilde Matteo Max Mia Michael Miguel Mila Milan Nadia Nadine Natalia Nicolas Niklas Nina Noah Nora Olga "
    "Oliver Olivia Oscar Otto Pablo Paolo Patrick Paul Paula Pavel Pedro Peter Petra Philip Pierre Rafael Rebecca Ricardo Rita Robert Roberto Rosa Ruth Samuel Sandra Sara Sebastian Silvia Simon Sofia Sophie Stefan Stefania Stephen "
    "Susan Sven Teresa Theo Thomas Tiago Tim Tobias Tom Tomas Ursula Valentina Vera Veronika Victor Walter William Wim Yvonne Zoe"
).split()

# Frequent family names of several countries.
FAMILY = (
    "Smith Jones Taylor Brown Wilson Evans Walker Wright Hughes Hall Clarke Murphy Kelly Baker Turner Parker Cooper Morgan Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann Koch Richter Klein Wolf Neumann Schwarz Zimmermann Krüger Hartmann Lange "
    "Dupont Durand Lefebvre Moreau Laurent Girard Roux Fournier Mercier Garnier García Martínez López Sánchez Pérez Gómez Ruiz Díaz Moreno Álvarez Romero Navarro Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci Marino Greco Conti Silva Santos Ferreira "
    "Pereira Oliveira Costa Rodrigues Martins Sousa Fernandes Jansen Bakker Visser Smit Meijer Mulder Bos Vos Peters Hendriks Dekker Nowak Novak Horvat Nielsen Hansen Larsen Berg Lund Kowalski Ivanova Petrov Nagy Kovács Popescu Yilmaz Demir Nguyen Chen Khan Patel"
).split()

# Carrier lines: {type} is an item, other slots are none, and "|" parts two lines. First those with items, by type of the first.
NAME = r"""
I'm {name}, hi.|{name} wrote this.|Yours, {name}|Cheers, {name}|Thank you, {name}|Sent by {name}|Account holder: {name}|Put me through to {name}, please.|My flatmate {name} collects it.|Give it to {name} at reception.|The contract lists {name} as tenant.|Is {name} still working here?|{name} lost a key.|Customer {name} complained twice.|Invoice to {name}|Passenger: {name}|We met Dr. {name} in {town}.|Mrs {name} has signed.|Ask for Mr. {name}.|Guests are {name} and {name}.|{name}, {name}, {name}|Cc {name}|On behalf of {name}|Prepared for {name}
Ich bin {name}.|Grüße von {name}|Herzlich, {name}|Danke, {name}|Gesendet von {name}|Kontoinhaber: {name}|Verbinden Sie mich mit {name}.|Meine Kollegin {name} holt es ab.|Geben Sie es {name} am Empfang.|Im Vertrag steht {name} als Mieter.|Frau {name} hat unterschrieben.|Herr {name} war nicht da.|Der Gast {name} reist morgen ab.|{name} hat den Schlüssel verloren.|Rechnung an {name}|Im Auftrag von {name}|Gezeichnet {name}|Beste Grüße {name}|Schöne Grüße {name}|Mit Grüßen {name}|Mit besten Grüßen {name}|Mit herzlichen Grüßen {name}|Liebe Grüße aus {town}, {name}|Hochachtungsvoll {name}
Moi c'est {name}.|Amitiés, {name}|Merci, {name}|Envoyé par {name}|Titulaire : {name}|Passez-moi {name}, s'il vous plaît.|Ma collègue {name} viendra le chercher.|Le bail est signé par {name}.|Mme {name} a signé.|M. {name} était absent.|{name} a perdu sa clé.|Note à {name}|De la part de {name}|Bien cordialement {name}
Soy {name}.|Un saludo, {name}|Gracias, {name}|Enviado por {name}|Titular: {name}|Póngame con {name}, por favor.|Mi compañera {name} lo recogerá.|El contrato nombra a {name}.|La señora {name} ha firmado.|El señor {name} no estaba.|{name} perdió la llave.|Nota para {name}|De parte de {name}
Io mi chiamo così: {name}.|Saluti da {name}|Grazie, {name}|Inviato da {name}|Intestatario: {name}|Mi passi {name}, per favore.|La collega {name} lo ritira.|Il contratto è di {name}.|La signora {name} ha firmato.|Il signor {name} era assente.|{name} ha perso la chiave.|Fattura per {name}|Da parte di {name}
Eu sou {name}.|Abraço, {name}|Obrigado, {name}|Enviado por: {name}|Titular da conta: {name}|Passe-me a {name}, por favor.|A minha colega {name} vai buscá-lo.|O contrato é de {name}.|A senhora {name} assinou.|O senhor {name} faltou.|{name} perdeu a chave.|Da parte de {name}
Ik ben {name}.|Hartelijke groet, {name}|Bedankt, {name}|Verstuurd door {name}|Rekeninghouder: {name}|Verbind mij door met {name}.|Mijn collega {name} haalt het op.|Het contract is van {name}.|Mevrouw {name} heeft getekend.|De heer {name} was er niet.|{name} is zijn sleutel kwijt.|Factuur voor {name}|Namens {name}
{name}|{name}.|✓ {name}.|({name})|- {name}|{name}:|"{name}"|{name} - {product}|{town}, {name}|OK, {name}|Fine, {name}.
""".strip()
EMAIL = r"""
Drop me a line at {email}.|Forward the PDF to {email}, thanks.|The mailbox {email} bounced again.|Login is {email}|User {email} signed up.|Cc: {email}|Is {email} still valid?|New address: {email}|We answer from {email} within a day.|Copy {email} and {email} in.|({email})|<{email}>|{email}|{email}.|✓ {email}.|- {email}|OK, {email}|Write {email}!|Yes, {email}.
Bitte an {email} weiterleiten.|Unter {email} bin ich erreichbar.|Das Postfach {email} ist voll.|Neue Adresse: {email}|Kopie an {email}|Kontakt per Mail: {email}|Transférez le tout à {email}.|Ma boîte est {email}.|Nouvelle adresse : {email}|Copie à {email}|Mande el archivo a {email}.|Mi buzón es {email}.|Copia a {email}|Nueva dirección: {email}
Inoltri tutto a {email}.|La mia casella è {email}.|Copia per {email}|Nuovo indirizzo: {email}|Envie tudo para {email}.|A minha caixa é {email}.|Cópia para {email}|Novo endereço: {email}|Stuur alles naar {email}.|Mijn postbus is {email}.|Kopie aan {email}|Nieuw adres: {email}
""".strip()
PHONE = r"""
Ring {phone} after six.|Text me: {phone}|You can phone us under {phone}, weekdays only.|Our line {phone} is dead.|Office {phone}|Cell {phone}|WhatsApp {phone}|Hotline: {phone}|Call back {phone} please.|The number {phone} no longer exists.|Dial {phone}, extension {2}.|Dial {phone} x{3}|{phone} ext {2}|({phone})|{phone}|{phone}.|✓ {phone}.|- {phone}|OK, {phone}|{phone} or {phone}
Meine Handynummer lautet {phone}.|Bitte um Rückruf unter {phone}.|Durchwahl: {phone}|Mobil: {phone}|Tel {phone}|Die Leitung {phone} ist tot.|Joignable au {phone}.|Mon portable : {phone}|Portable {phone}|Rappelez le {phone} demain.|Mi móvil es el {phone}.|Móvil: {phone}|Llame otra vez al {phone}.|Teléfono {phone}
Il mio cellulare è {phone}.|Cellulare: {phone}|Richiami il {phone} domani.|Telefono {phone}|O meu telemóvel é o {phone}.|Telemóvel: {phone}|Volte a ligar para {phone}.|Telefone {phone}|Mijn mobiele nummer is {phone}.|Mobiel: {phone}|Bel terug op {phone}.|Telefoon {phone}
""".strip()
ID_NUMBER = r"""
Social security no. {id_number}|SSN: {id_number}|SSN {id_number} is on file.|The social number we hold is {id_number}.|My social is {id_number}.|Passport: {id_number}|My passport has the number {id_number}.|Tax number {id_number}|Taxpayer id {id_number}|National insurance {id_number}|Driving licence {id_number}|Identity card no. {id_number}|ID {id_number}, issued in {town}.|The insured person's number is {id_number}.|{id_number}|{id_number}.|✓ {id_number}.|- {id_number}|OK, {id_number}|The document carries {id_number}.
Steuernummer {id_number}|Steuer-ID: {id_number}|Sozialversicherungsnummer {id_number}|Reisepass {id_number}|Ausweis-Nr. {id_number}|Mein Ausweis hat die Nummer {id_number}.|Numéro fiscal {id_number}|NIR {id_number}|Matricule {id_number}|Passeport {id_number}|CNI {id_number}|Ma carte porte le numéro {id_number}.|DNI: {id_number}|NIF {id_number}|Pasaporte n.º {id_number}|Mi documento es el {id_number}.|Seguridad social {id_number}
Cod. fisc. {id_number}|C.F. {id_number}|Passaporto n. {id_number}|Carta d'identità n. {id_number}|Il documento ha il numero {id_number}.|NIF: {id_number}|Contribuinte {id_number}|Passaporte n.º {id_number}|Cartão n.º {id_number}|O documento tem o número {id_number}.|BSN: {id_number}|Burgerservicenummer {id_number}|Paspoort nr. {id_number}|Identiteitskaart {id_number}|Het document heeft nummer {id_number}.
""".strip()
ADDRESS = r"""
We moved to {address} last year.|Bring it round to {address}.|The van stops at {address}, {town}.|Bill to {address}|Office: {address}, {town}|Leave the box at {address}, floor {1}.|Meet me outside {address}.|My flat is at {address} in {town}.|Send everything to {address}, unit {2}.|Home address {address}|Collect it from {address} in {town} today.|{address}|{address}.|✓ {address}.|- {address}|OK, {address}|{address}, {town}|{address}, {4} {town}
Wir sind in die {address} gezogen.|Bringen Sie es zur {address} in {town}.|Mein Büro liegt am {address}.|Wohnhaft {address}, {4} {town}|Adresse: {address}|Lieferadresse {address}|Nous avons déménagé au {address}.|Apportez-le au {address}, {town}.|Mon bureau est au {address}.|Domicile : {address}|Adresse de livraison {address}
Nos mudamos a {address}.|Tráigalo a {address}, {town}.|Mi oficina está en {address}.|Domicilio: {address}|Ci siamo trasferiti in {address}.|Lo porti in {address}, {town}.|Il mio ufficio è in {address}.|Residenza: {address}|Mudámo-nos para a {address}.|Traga-o à {address}, {town}.|O meu escritório fica na {address}.|Residência: {address}|Wij zijn verhuisd naar de {address}.|Breng het naar {address} in {town}.|Mijn kantoor is aan de {address}.|Woonadres: {address}
""".strip()
BLOCKS = r"""
{name} / {address} / {phone} / {email}|{name} | {phone} | {email}|{name}; {address}; {town}|{name}, {phone}|{name}, {address}, {email}|{email} / {phone}|{phone} / {email} / {name}|{name} - {id_number}|{name} <{email}>|{email}, {name}|{address} | {phone}|{id_number} / {name}
{name}\n{address}\n{phone}\n{email}|{name}\n{address}\n{town}|{name}\n{phone}|{email}\n{phone}|{name}\n{id_number}\n{address}|{address}\n{phone}|{id_number}\n{email}|{name}\n{email}\n{phone}
""".strip()
HELD = (NAME, EMAIL, PHONE, ID_NUMBER, ADDRESS, BLOCKS)

# Lines without an item, though some look like one.
NONE = r"""
Parcel {4} {4} {4} {2} left {town}.|Shipment {2} {4} {4} {4} {2}|Trace {2} {3} {4} {4} is lost.|Part number {3}-{2}-{4} is out of stock.|The {product} lamp fits box {2}-{3}-{4}.|Order {code}: 2,310.50 USD|Bill {4}/{2}-{3}|Counter at {3}.{4} m3|Hall {2}, {town}|Stage {1} of {2}, 08:45-10:15|Pointer 0x{3}AB{2}|Link https://www.example.net/p/{4}{3}|See www.example.com/{2}|Open https://docs.example.org/a/b/{4}{4}|http://{product}.example/t/{code}?x={3}|https://shop.example.net/o/{2}-{4}{3}|Version {1}.{2}.{1} of 2027-11-{2}|Ping @{product} later|The image logo@3x.png is too big.|{product} Tools & {product} Sons Ltd|{2} hours|({2}/{2})|Score {2}:{2}|Code {3} in row {4}|Sum {4},{2} EUR|{4}-{2}-{2}|{2}:{2}|Item {4}-{3}|Run {4}{4}|Device {code}{3}|Ticket {code}|{product} {product}|{town} {town}|{product} {3}|Chapter {1}, verse {2}|Route {2}, {town} West|Since 2019 {product} sold {4} units.|{given} is ill today.|Thanks {given}!|Hi {given},|Hello {given}, how are you?|Mr {family} called.|Dear Ms {family},|Frau {family} ist krank.|Hallo {given},|Bonjour {given},|Señor {family}, gracias.|Ciao {given}|Olá {given},|Beste {given},|{given} and {given} agreed.|The {town} office and the {product} office merged.|{product}, {town}, {town} and {product} are listed.|On 3 June the {town} branch opens.|Pressure {2}.{2} bar at {2}.{1} C|Ref. {3} {3} {4}|IBAN missing|Batch {code}|(no. {code})|(id {code})|#{code}|ISBN {3}-{1}-{2}-{4}|GPS {2}.{4}, {1}.{4}|{2} kg, {3} mm, {2} %|PO box {3}|Zip {4}|Bus {3} to {town}|Gate {1}{2}
Who owns file {code} in {town}?|Why is request {code} for {product} late?|How do I join two lists under {code}?|Can {product} read {code} by tonight?|Wer kennt die Akte {code} aus {town}?|Warum hängt der Vorgang {code}?|Kann {product} heute {code} lesen?|Qui suit l'affaire {code} à {town} ?|Pourquoi la demande {code} traîne-t-elle ?|¿Quién lleva el caso {code} en {town}?|¿Por qué tarda la solicitud {code}?|Chi segue la pratica {code} a {town}?|Perché la richiesta {code} tarda?|Quem trata do processo {code} em {town}?|Porque demora o pedido {code}?|Wie volgt zaak {code} in {town}?|Waarom duurt aanvraag {code} zo lang?
You help the guests of {town}.|Be kind and call the functions of {product}.|Sei höflich und rufe die Funktionen von {product} auf.|Aidez les visiteurs de {town}.|Ayuda a los visitantes de {town}.|Aiuta gli ospiti di {town}.|Ajuda os hóspedes de {town}.|Help de gasten van {town}.|Answer me in Spanish, would you?|Right, do it|Antworte mir lieber auf Italienisch.|"one moment"|"a presto"|{"times": ["10:30", "11:00"], "free": false}|Morning all at {town}!|Best, your {product} crew|{product} e {product} arrivano.|{product} y {town} no.|{town} e {town}|A {product} e a {town} fecham.|O {product} e os outros.|E-Mail folgt.|E-Mail leer|Bitte per E-Mail senden.|Grüße aus {town}|Das Gerät {product} summt.|Akte {code} ruht bis Mai.|Only {product} supports that.
I cannot do this for you.|We are unable to say more.|Das kann ich leider nicht tun.|Je ne peux pas le faire.|No puedo hacerlo.|Non posso farlo.|Não posso fazer isso.|Dat kan ik niet doen.|{town} shuts at {2}.|News: {product} and {product} work again.
""".strip()

# Ordinary sentences of the languages: no item in them.
PLAIN = r"""
The lift in {town} needs {2} days of repair and nobody minds.|Last year {4} people asked about {product}, and half came from {town}.|Whenever you sort the shelf, keep {2} boxes free.|Everybody at {town} liked the new map, although it was late.|Our neighbours told me {product} breaks easily in winter.|She promised that {product} would ship on Friday, but no one believed it.|A row without a heading is skipped.|Is it true that {product} can be washed at {2} degrees?|Take the second left, then wait near the bridge until the bell rings.|The teacher put the keys in the drawer and went home early.
Der Aufzug in {town} braucht {2} Tage, und niemand stört sich daran.|Im letzten Jahr fragten {4} Leute nach {product}, die Hälfte aus {town}.|Wer das Regal sortiert, lässt bitte {2} Kisten frei.|Die Nachbarn sagen, {product} gehe im Winter leicht kaputt.|Der Lehrer legte die Schlüssel in die Schublade und ging früh nach Hause.|Eine Zeile ohne Überschrift wird übersprungen.|Stimmt es, dass man {product} bei {2} Grad waschen kann?|Die Brücke bei {town} ist seit gestern gesperrt.|Ihre Bestellung liegt vorn.|Unsere Werkstatt ruft zurück.|Unsere Leute prüfen das.|Does {product} work?|Later this year {product} comes.|Jeder Gast bekommt Ihre Broschüre.|Herzlichen Dank für Ihren Besuch.|Jede Woche kommt Ihr Paket.|Das Modell {product} und der Ort {town} passen.|Der Laden {product} hat Ihre Tasche.
L'ascenseur de {town} sera réparé en {2} jours et cela ne gêne personne.|L'an dernier, {4} personnes ont demandé {product}, la moitié depuis {town}.|Quand vous rangez l'étagère, laissez {2} boîtes libres.|Les voisins disent que {product} casse vite en hiver.|Le maître a mis les clés dans le tiroir avant de rentrer.|Une ligne sans titre est ignorée.|Le pont de {town} est fermé depuis hier.|À {town} il pleut.|Bonjour, Avez-vous {product} ?|À {town}
El ascensor de {town} tarda {2} días en arreglarse y a nadie le importa.|El año pasado {4} personas preguntaron por {product}, la mitad de {town}.|Al ordenar el estante, deje {2} cajas libres.|Los vecinos dicen que {product} se rompe en invierno.|El maestro guardó las llaves en el cajón y se fue temprano.|Una fila sin título se omite.|El puente de {town} está cerrado desde ayer.|En {town}|Es de {town} y viene de {town}.|A {town}
L'ascensore di {town} richiede {2} giorni e nessuno se ne lamenta.|L'anno scorso {4} persone hanno chiesto di {product}, metà da {town}.|Quando ordini lo scaffale, lascia libere {2} scatole.|I vicini dicono che {product} si rompe d'inverno.|Il maestro mise le chiavi nel cassetto e tornò a casa presto.|Una riga senza titolo viene saltata.|Il ponte di {town} è chiuso da ieri.|A {town}|Viene da {town} e va a {town}.|Buonasera, Avete {product}?
O elevador de {town} demora {2} dias e ninguém se importa.|No ano passado {4} pessoas perguntaram por {product}, metade de {town}.|Ao arrumar a prateleira, deixe {2} caixas livres.|Os vizinhos dizem que {product} parte no inverno.|O professor pôs as chaves na gaveta e saiu cedo.|Uma linha sem título é ignorada.|A ponte de {town} está fechada desde ontem.|Em {town}|É de {town}.|Boa noite, Tem {product}?
De lift in {town} heeft {2} dagen nodig en niemand vindt dat erg.|Vorig jaar vroegen {4} mensen naar {product}, de helft uit {town}.|Wie de plank opruimt, laat {2} dozen vrij.|De buren zeggen dat {product} in de winter snel stukgaat.|De leraar legde de sleutels in de la en ging vroeg naar huis.|Een regel zonder kop wordt overgeslagen.|De brug bij {town} is sinds gisteren dicht.|In {town}|Het komt uit {town} van {product}.|Goedenavond, Heeft u {product}?
""".strip()

_SLOT = re.compile(r"\{(\w+)\}")
TYPES = ("name", "email", "phone", "id_number", "address")
#: Part of the lines whose carrier words are made unknown, so that items are learned by their own look, and of each such line's words.
BLURRED, BLUR = 0.45, 0.7


class _Fill:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def upper(self, n: int) -> str:
        return "".join(self.r.choice("ABCDEFGHJKLMNPQRSTUVWXYZ") for _ in range(n))

    def form(self, pattern: str) -> str:
        """A pattern with # as a digit and @ as a capital."""
        return re.sub("[#@]", lambda m: self.digits(1) if m.group() == "#" else self.upper(1), pattern)

    def word(self, low: int = 1, high: int = 3) -> str:
        """An invented word of some syllables."""
        r = self.r
        s = ""
        for _ in range(r.randint(low, high)):
            s += r.choice(("b", "br", "c", "ch", "d", "f", "fl", "g", "gr", "h", "j", "k", "kl", "l", "m", "n", "p", "pr", "qu", "r", "s", "sch", "st", "t", "tr", "v", "w", "z")) + r.choice("aaeeiioouuyäé" if r.random() < 0.1 else "aaeeiioou") + r.choice(("", "", "l", "m", "n", "r", "s", "x", "nd", "rt", "ss", "nt", "ck", "lm"))
        return s

    def given(self) -> str:
        return self.r.choice(GIVEN) if self.r.random() < 0.9 else self.word(2, 2).capitalize()

    def family(self) -> str:
        r = self.r
        x = r.random()
        if x < 0.3:
            return r.choice(FAMILY)
        if x < 0.36:
            return r.choice(("van", "van der", "de", "von", "da", "di", "del")) + " " + r.choice(FAMILY)
        return self.word(1, 2).capitalize() + r.choice(("", "", "mann", "berg", "er", "sen", "son", "ski", "ini", "ez", "os", "ova", "eau", "stra", "ley", "ton", "ia", "au", "elli", "holt", "dorf", "ström"))

    def name(self) -> str:
        r, g, f = self.r, self.given(), self.family()
        x = r.random()
        s = f"{g} {f}" if x < 0.5 else f"{g[0]}. {f}" if x < 0.63 else f"{g} {self.upper(1)}. {f}" if x < 0.74 else f"{f}, {g}" if x < 0.85 else f"{g} {f}-{self.family()}" if x < 0.97 else f"{g} {self.given()} {f}"
        x = r.random()
        return s.upper() if x < 0.12 else s.lower() if x < 0.22 else s

    def host(self) -> str:
        r = self.r
        top = r.choice(("com", "net", "org", "eu", "de", "fr", "es", "it", "pt", "nl", "info", "test", "example", "invalid", "io"))
        return r.choice((f"example.{r.choice(('com', 'net', 'org'))}", f"{self.word()}.{top}", f"{r.choice(('mail', 'post', 'inbox', 'web'))}.{self.word()}.{top}", f"{self.word(1, 1)}-{self.word(1, 1)}.{top}", f"{self.word(1, 2)}.{top}"))

    def email(self) -> str:
        r, g, f = self.r, self.given().lower(), re.sub(r"\W", "", self.family().lower())
        a = r.choice((f"{g}.{f}", f"{g}-{f}", f"{f}{r.randint(1, 2015)}", f"{f}_{r.randint(1, 99)}", f"{g[0]}{f}", f"{g}+{self.word(1, 2)}", f"{g}_{f}", f, g, f"{g}{self.digits(2)}", f"{g[0]}.{f}", self.word()))
        host = self.host()
        x = r.random()
        s = f"{a}@{host}" if x < 0.8 else f"{a} at {host.replace('.', ' dot ')}" if x < 0.9 else f"{a}{r.choice(('(at)', ' [at] ', ' (at) ', '[at]'))}{host if r.random() < 0.7 else host.replace('.', r.choice((' (dot) ', '[dot]', ' dot ')))}"
        return s.upper() if r.random() < 0.1 else s

    def phone(self) -> str:
        f = self.r.choice((
            "(###) ###-####", "###-###-####", "###.###.####", "+1 ### ### ####", "+1##########", "1-###-###-####", "(###)###-####", "+44 ## #### ####", "+44 #### ######", "0#### ######", "0### ### ####", "0## ##### ###", "0##/#####-###", "0##/######", "+49 ## ########", "+49 ### #######", "0049 ## ########", "0#### #####",
            "0# ## ## ## ##", "0#.##.##.##.##", "0#########", "+33 # ## ## ## ##", "0033 # ## ## ## ##", "0### ######", "9## ### ###", "6## ## ## ##", "+34 ### ### ###", "+39 ### #######", "0## #######", "+351 ### ### ###", "0##-#######", "06-########", "+31 # ########", "+31 ## #######", "(0##) ### ## ##", "+### ## ### ####", "+### (#) ## ## ## ##", "+###-#######", "00### ### ### ###", "+## ### ######", "0###-######", "00## ## ### ####",
        ))
        return self.form(f)

    def id_number(self) -> str:
        f = self.r.choice((
            "###-##-####", "### ## ####", "#########", "@@ ## ## ## @", "@@######@", "@@@@@######@@#@@", "@########", "@@#######", "@@######", "##@@#####", "@@@######", "## ### ### ###", "###########", "##/###/#####", "@0@@#####", "@########@", "# ## ## ## ### ### ##", "# ## ## ## ### ###", "#############", "###############",
            "########@", "########-@", "@#######@", "@-#######-@", "##.###.###-@", "@@@@@@##@##@###@", "@@#####@@", "#########", "### ### ###", "######## # @@#", "####.##.###", "###.###.###", "@@####@@#", "@@@@@##########",
        ))
        return self.form(f)

    def address(self) -> str:
        r = self.r
        n = f"{r.randint(1, 260)}{r.choice(('', '', '', 'a', 'A', 'B', 'c'))}"
        own = self.word(1, 2).capitalize()
        en = r.choice("Maple Oak Church Park Victoria Mill King Elm Bridge Chapel Albert Abbey Meadow Castle Spring Hill".split()) if r.random() < 0.5 else r.choice((own, f"{own} {self.word(1, 1).capitalize()}", f"St {self.given()}", f"Old {own}", f"New {r.choice(FAMILY)}"))
        de = r.choice("Haupt Bahnhof Schiller Goethe Wald Dorf Markt Ring Mozart Post Feld Sonnen".split()) if r.random() < 0.5 else own
        nl = r.choice("Dorps Nieuw Wilhelmina Juliana Parallel Station Haven Eiken Oranje Raadhuis".split()) if r.random() < 0.5 else own
        art = r.choice(("de la ", "du ", "des ", "de l'", "de ", ""))
        fr = r.choice(("Victor Hugo", "de la République", "de Paris", "du Stade", "des Acacias", "Pasteur", "de la Mairie", "du Château Vert")) if r.random() < 0.5 else art + own + r.choice(("", f" {self.word(1, 2).capitalize()}"))
        es = r.choice(("Mayor", "de la Constitución", "del Carmen", "de Cervantes", "de los Pinos", "Real", "de San Juan")) if r.random() < 0.5 else r.choice(("de la ", "del ", "de los ", "de las ", "de ", "")) + own + r.choice(("", "", f" {self.word(1, 1).capitalize()}"))
        it = r.choice(("Roma", "Dante", "Mazzini", "della Libertà", "dei Mille", "del Corso", "San Marco")) if r.random() < 0.5 else r.choice(("della ", "dei ", "del ", "delle ", "")) + own
        pt = r.choice(("da Liberdade", "do Comércio", "de Santa Maria", "dos Combatentes", "25 de Abril", "das Oliveiras")) if r.random() < 0.5 else r.choice(("da ", "do ", "dos ", "das ", "")) + own + r.choice(("", "", f" {self.word(1, 1).capitalize()}"))
        return r.choice((
            lambda: f"{n} {en} {r.choice('Street St Road Rd Lane Drive Court Avenue Ave Close Way Place Terrace Crescent Gardens Boulevard Ln Dr'.split())}", lambda: f"{n} {en} {r.choice('Street St Road Rd Lane Drive Court Avenue'.split())}",
            lambda: f"{de}{r.choice('straße str. str weg allee gasse platz ring damm ufer strasse'.split())} {n}", lambda: f"{r.choice(('Am', 'An der', 'Im', 'Zum'))} {own} {n}",
            lambda: f"{n}{r.choice(('', '', ','))} {r.choice('rue avenue chemin allée place boulevard impasse quai route'.split())} {fr}",
            lambda: f"{r.choice('Calle Plaza Camino Avenida Paseo Ronda Travesía C/'.split())} {es}{r.choice(('', '', ','))} {n}",
            lambda: f"{r.choice('Via Viale Piazza Corso Vicolo Largo Strada'.split())} {it}{r.choice(('', '', ','))} {n}",
            lambda: f"{r.choice('Rua Travessa Avenida Largo Praça Alameda Estrada'.split())} {pt}{r.choice(('', '', ','))} {n}",
            lambda: f"{nl}{r.choice('straat laan kade weg plein gracht dijk singel steeg pad'.split())} {n}",
        ))()

    def town(self) -> str:
        return (self.word(1, 2) + self.r.choice(("", "", "dal", "burg", "hausen", "port", "minster", "ville", "beek", "ano", "ela", "heim", "gate", "ness"))).capitalize()

    def product(self) -> str:
        return self.word(2, 3).capitalize()

    def code(self) -> str:
        n = self.r.randint(5, 9)
        s = "".join(self.r.choice("ABCDEFGHKLMNPQRSTVWXYZ0123456789") for _ in range(n))
        s = self.r.choice((s, s, f"{s[:3]}-{s[3:]}", f"{s[:2]}/{s[2:]}", f"{s[:2]}/{s[2:4]}/{s[4:]}"))
        return s.lower() if self.r.random() < 0.3 else s

    def blurred(self, part: str) -> str:
        """Carrier words made unknown, each in its own case."""

        def other(m: re.Match) -> str:
            w = m.group()
            if self.r.random() > BLUR:
                return w
            new = self.word(1, 3)
            return new.upper() if w.isupper() else new.capitalize() if w[0].isupper() else new

        return re.sub(r"[^\W\d_]{2,}", other, part)

    def one(self, line: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans, at = "", [], 0
        keep = (lambda s: s) if self.r.random() > BLURRED else self.blurred
        for m in _SLOT.finditer(line):
            out += keep(line[at : m.start()])
            at = m.end()
            slot = m.group(1)
            v = self.digits(int(slot)) if slot.isdigit() else getattr(self, slot)()
            if slot in TYPES:
                spans.append((len(out), len(out) + len(v), slot))
            out += v
        return out + keep(line[at:]), spans


def lines(block: str) -> list[str]:
    """A block's lines; "|" inside one stands between spaces."""
    return [f.replace("\\n", "\n") for row in block.split("\n") for f in re.split(r"(?<! )\|(?! )", row) if f]


def apart(every: list[str], kept: bool) -> list[str]:
    """Every sixth line is kept from training, to be measured on."""
    return [x for i, x in enumerate(every) if (i % 6 == 5) == kept]


def labelled_examples(n: int, seed: int = 11, unseen: bool = False) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to four lines each, with the spans of their items; ``unseen`` ones from the lines kept from training."""
    fill, rows = _Fill(seed), []
    held, none, plain = [apart(lines(b), unseen) for b in HELD], apart(lines(NONE), unseen), apart(lines(PLAIN), unseen)
    for _ in range(n):
        text, spans = "", []
        for _ in range(fill.r.choice((1, 1, 2, 2, 3))):
            x = fill.r.random()
            s, own = fill.one(fill.r.choice(fill.r.choice(held) if x < 0.5 else none if x < 0.75 else plain))
            if not own and fill.r.random() < 0.08:
                s = s.upper()
            if text:
                text += fill.r.choice((" ", " ", " ", "\n", "\n", "; "))
            spans += [(a + len(text), b + len(text), k) for a, b, k in own]
            text += s
        rows.append((text, spans))
    return rows
