"""Labelled text for training the personal-information tagger: spans are labelled as they are written.

Everything is drawn from a seeded generator. Carrier sentences are everyday writing in
English, German and French (letters, forms, chat, deliveries, clinics, schools, clubs,
hotels); names come from lists, syllables and any capitalised word; numbers have the shapes
of several countries. Filler and look-alikes that are not personal (orders, versions,
amounts, eponyms, companies, places) are mixed in, most of it made of the words of a
public tokenizer's vocabulary, whose path is a parameter.
"""

from __future__ import annotations

import base64
import random
import re
from functools import lru_cache
from pathlib import Path

TYPES = ["email", "phone", "id_number", "address", "name"]
VOCABULARIES = ("/opt/tokenizers/byte_bpe_50k.tiktoken", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Building blocks of generated text.
GIVEN = (
    "Aaron Abigail Adam Adele Agnieszka Ahmed Aisha Alan Alejandro Alessia Alice Amélie Amina Andrzej André Anton Arjun Arthur Astrid Aurélie Barbara Beatriz Benjamin Bernd Birgit Björn Brigitte Carlos Caroline Catherine Cécile "
    "Charlotte Christoph Claire Claudia Clément Daniel Deborah Diego Dmitri Dorothea Edward Eleni Elisabeth Émile Emma Erik Esther Eva Fatima Fernando Florian François Franziska Frédéric Gabriel Georg Gérard Gisela Giulia Grace "
    "Guillaume Günter Hana Hannah Hans Harold Hélène Ibrahim Ingrid Isabel Ivan Jacqueline James Jan Javier Jean Jens Jessica Joanna Johannes Jorge José Julia Jürgen Katarzyna Katharina Keiko Kenji Klaus Kwame Lars Laura Léa Leila "
    "Linda Lorenzo Louise Lucía Ludwig Łukasz Magdalena Manuel Margaret Marie Mark Marta Martin Mateusz Matthias Mei Michael Michèle Miguel Mohammed Monika Nadine Natasha Nicolas Nina Oliver Óscar Pascal Patricia Patrick Pauline "
    "Peter Philippe Pierre Rachel Rainer Ramón René Renate Richard Robert Sabine Samuel Sandra Sanjay Sarah Sébastien Siobhán Sophie Stefan Susan Sven Sylvie Tatiana Theresa Thomas Tim Tomasz Ulrike Ursula Valérie Victor Wei William "
    "Xavier Yasmin Yves Zoë"
).split()
FAMILY = (
    "Adams Bailey Baker Barnes Becker Bell Bennett Bernard Bianchi Blanc Brooks Brown Carter Chen Clarke Collins Costa Cox Davies Díaz Dubois Durand Edwards Engel Evans Ferrari Fischer Fontaine Foster Fuchs García Garnier Gómez "
    "González Graham Gray Green Gupta Hall Harris Hartmann Hernández Hoffmann Horváth Hughes Hussain Íñiguez Ivanov Jackson Jansen Jensen Johnson Jones Kaiser Kaminski Kaya Keller Khan Kim King Klein Koch Kowalski Krüger Kumar Lambert "
    "Lang Laurent Lefèvre Lehmann Lewis Lim López Marchand Martínez Mayer Meyer Mitchell Möller Moreau Morel Morris Müller Murphy Nakamura Navarro Neumann Nguyen Novák Núñez Okafor Olsen Park Parker Patel Pereira Peters Popescu Price "
    "Richter Rivera Roberts Rossi Roux Ryan Sánchez Santos Schmidt Schneider Schröder Schulz Scott Shaw Silva Simon Singh Smith Stone Suzuki Svensson Szabó Tanaka Taylor Tran Turner Vogel Wagner Walker Ward Weber Weiß White Wilson "
    "Wójcik Wolf Wright Yılmaz Young Zhang Zimmermann Żak"
).split()
PARTICLE = ["van", "van der", "van den", "von", "von der", "de", "de la", "del", "della", "di", "da", "dos", "le", "ter", "al", "bin", "zu", "af"]
ONSET = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kl kn kr l m n p pf ph pl pr qu r s sch sh sk sl sp st str t th tr v w wr y z".split()
VOWEL = "a a e e i i o o u ae ai au ea ee ei eu ia ie io oa oe oo ou y".split()
CODA = "b ch ck d ff g k l ld ll lm ln lt m mm n nd ng nk nn ns nt p r rd rg rk rl rm rn rt s sk ss st t th tt v x z".split()
FAMILY_END = "a ak al and ans ard ari as au bach back baum beck bell berg berger berry bert by dal din do eau ell en er ert es et etti ev ez feld field ford gaard ger ham hardt hauser heim hill ic ieu in ini is ius kamp ke kov land ler lev ley li ling lis lo low lund man mann maier mer mont more ner nik no oğlu on os ot oux ov ova owicz ra ran rich ridge ro rup schmidt sen shaw ska ski skog son stad stedt stein sted sto strom ström sson ton tti ulus va vic ville vist well wick wood worth xi yan zen zzi".split()
TOWN_END = "ach au bach berg bergen born bourg bridge bruck burg burn bury by cester chester dale dorf en ey feld ford furt gate ham hausen haven heim hill hofen holm holt hurst ingen ington kirchen lac land leben leigh ley lieu loch low minster mont more mouth münde nau ness ney penny pool port rode roda sey shire stadt stead stein stow thal thorpe ton vale ver vik ville wald ward well wich wick worth".split()
#: Kinds of street and the words around them, in English, German, French, and some neighbours.
STREET_EN = "Road Rd Rd. Street St St. Lane Ln Avenue Ave Ave. Court Ct Close Way Drive Dr Place Pl Hill Square Terrace Gardens Crescent Boulevard Blvd Row Mews Walk Parade Parkway Circle Trail Grove Rise Green Quay Park Highway View".split()
STREET_DE = "straße str. strasse gasse weg allee platz ring damm ufer steig stieg hof markt graben berg".split()
STREET_DE_APART = ["Straße", "Str.", "Strasse", "Allee", "Weg", "Gasse", "Platz", "Ring", "Damm", "Ufer"]
STREET_FR = ["rue", "avenue", "av.", "chemin", "boulevard", "bd", "place", "allée", "impasse", "quai", "route", "cours", "square", "passage", "rue de", "rue du", "rue de la", "rue des", "rue de l'", "avenue de", "avenue du", "avenue de la", "chemin de", "chemin du", "chemin des", "boulevard de la", "boulevard du", "place de la", "place des", "place du", "allée de", "allée des", "impasse du", "impasse des", "quai de", "quai du", "route de", "cours de", "cours de la"]
STREET_OTHER = ["Calle", "Calle de", "Avenida de", "Plaza", "Paseo de", "Via", "Via del", "Piazza", "Corso", "Viale", "Rua da", "Rua do", "Travessa"]
FLAT = ["Flat", "Apt", "Apt.", "Apartment", "Unit", "Suite", "Ste", "Room", "Floor", "Studio"]
STATES = "AL AZ CA CO FL GA IL IN MA MD MI MN MO NC NJ NY OH OR PA TX VA WA WI".split()
#: Labels of identity numbers, as such documents are commonly called, and what may stand between label and number.
LABELS = (
    "SSN|SSN|Social Security Number|Social Security No.|soc sec|SIN|National Insurance number|NI number|NINO|Passport No|Pass number|travel document|ID|ID card|ID number|ID no.|identity card|identity document|identity number|national ID|citizen number|tax ID|Tax No|TIN|ITIN|UTR|VAT ID|driving licence|"
    "driver's license|residence permit|Steuer-ID|Steuernummer|Steuer-Identifikationsnummer|Steuer-IdNr.|StNr|Personalausweis|Personalausweisnummer|Ausweis|Ausweisnummer|Ausweis-Nr.|Perso|Reisepass|Reisepassnummer|Pass-Nr.|Passnummer|Sozialversicherungsnummer|SV-Nummer|SV-Nr.|Rentenversicherungsnummer|RVNR|"
    "Führerschein|AHV-Nr.|numéro fiscal|n° fiscal|NIF|numéro de sécurité sociale|n° de sécurité sociale|n° sécu|NIR|numéro d'identité|carte d'identité|carte nationale d'identité|CNI|passeport|passeport n°|n° de passeport|titre de séjour|permis de conduire|AVS"
).split("|")
LABEL_OF = "passport|passport|social security|social insurance|national insurance|national identity|identity|tax|taxpayer|income tax|pension insurance|licence|immigration|travel document|identity card|ID card|resident".split("|")
LABEL_END = ["", "", " number", " no.", " no", " card", " document", " ID", " ref", " reference", " code", " papers", " nr", " digits"]
AFTER_LABEL = ["", "", "", "", ":", ":", ":", " no.", " no", " No.", " no.:", " number", " number:", " Nr.", " Nr.:", " n°", " n° :", " :", " #", " is", " =", " -", " lautet", " est le", " est", " (", ",", " such as", " reads", " reading", " was", ", namely", " with number", " with the number", " mit der Nummer", " portant le numéro", " of the owner:", "\n", " ="]
TITLES = ["", "", "", "", "Dr. ", "Dr ", "Ms ", "Mr ", "Mrs ", "Miss ", "Prof. ", "Professor ", "Mme ", "Mlle ", "M. ", "Frau ", "Herr ", "Herrn ", "Sir ", "Madame ", "Monsieur ", "Ms. ", "Mr. ", "Mrs. ", "Sister ", "Captain "]
EPONYM = "algorithm aphasia burner camera catheter coil colouring constant curve disease distribution effect engine equation flask formula funnel hypothesis inequality knot lamp law lecture machine manoeuvre matrix medal paradox pipette prism prize process pump reaction reflex ring scale score spline stain stove syndrome theorem transform tube wheel".split()
EPONYM_DE = "Verfahren Gleichung Kolben Brenner Zahl Effekt Formel Skala Satz Pumpe Lampe Kurve Reaktion Syndrom Motor Prinzip Rohr".split()
EPONYM_FR = "méthode loi théorème formule effet échelle lampe pompe équation syndrome nombre principe tube".split()
FIRM = ["Ltd", "Ltd.", "GmbH", "AG", "Inc.", "LLC", "SARL", "S.A.", "& Sons", "& Co.", "Group", "Instruments", "Books", "Bakery", "Partners", "KG", "Foundation", "University", "College", "Hospital", "Airport", "Stadium", "Hotel"]
ROLE = "teacher neighbour cashier coach porter nurse cook pilot driver librarian gardener treasurer plumber notary dentist choirmaster caretaker Hausmeister Nachbarin Trainerin Ärztin Bäcker Kollege voisin gérante professeure facteur boulanger infirmière".split()
MONTHS = "January February March April May June July August September October November December Januar Februar März Mai Juni Juli Oktober Dezember janvier février mars avril juin juillet août septembre octobre novembre décembre".split()
#: Words that join others, by language.
JOIN = [
    "the the the a an of of to to in in and and is was for on at with by from that it as be this are not or but have has had his her their its which who when if than then so into over after before until while because would could will can may must more most no only also very just about between through during without under".split(),
    "der der die die das den dem des ein eine einen einer und und in im ist war zu zum zur von vom mit auf für an am bei nach aus als auch nicht noch nur schon wie dass wenn weil oder aber sich sie er es wir ihr hat hatte wird wurde werden kann muss soll über unter durch gegen ohne um bis seit vor zwischen mehr sehr".split(),
    "le le la la les un une des de de du et et en à au aux est était pour sur dans avec par sans sous que qui ne pas plus ce cette ces son sa ses leur il elle on nous vous ils elles a ont sera peut doit mais ou où donc comme si très aussi après avant depuis pendant entre chez vers".split(),
]
#: Everyday sentences with places for what is personal (capitals) and what is not.
CARRIERS = (
    "Dear {T}{N},|Dear {N}, thank you for your order {c}.|My name is {N} and I am writing about invoice {c}.|I spoke with {N} yesterday.|{N} will pick up the children at {t}.|The parcel is for {N}, {A}.|Please forward all mail to {A}.|We moved to {A} on {d}.|Our new address is {A}.|Home: {A}|"
    "You can reach me on {P} after {t}.|Ring {P} and ask for {N}.|Mobile {P}, office {P}.|Fax: {P}|phone={P}; mail={E}|My mobile is {P}, text me!|hey, {N} here, my new number is {P} :)|lol just mail {E}|send the photos to {E} please|{E} bounced, try {E}.|Reply to {E} by {d}.|E-mail: {E}|To: {E}|Cc: {E}, {E}|"
    "<{E}> wrote:|On {d}, {N} <{E}> wrote:|From: {N} <{E}>|Sender: {N}|Yours sincerely,\n{N}|Best wishes,\n{N}\n{A}|Kind regards\n{N}\n{P}\n{E}|Love, {G}|Thanks, {G}|{N}, our {role}, retires in {n} weeks.|The {role}, {N}, has the keys.|Our {role} {N} is on leave until {d}.|{N} and {N} were married on {d}.|"
    "{N} ({n1}) won the race ahead of {N}.|Team: {N}, {N}, {N} and {N}.|{N}; {N}; {N}|Attending: {N}, {N}. Excused: {N}.|Minutes taken by {N}.|Proposed by {N}, seconded by {T}{N}.|Patient: {N}, born {d}, {I}.|Patient {N} was admitted on {d}; next of kin {N}, {P}.|Referred by {T}{N} at {t}.|Policy holder {N} of {A}.|"
    "Applicant: {N}\nAddress: {A}\nPhone: {P}\nE-mail: {E}\n{I}|Name: {N}|Full name: {N}|Guest name: {N}, room {n}|Name | {N}|{n};{N};{P};{E}|{N},{E},{P}|\"name\": \"{N}\", \"phone\": \"{P}\"|\"email\": \"{E}\"|\"address\": \"{A}\"|{I}|Please quote {I} on the form.|The clerk copied {I} by hand.|{I} expires on {d}.|"
    "Proof of identity: {I}.|{N} showed {I} at the counter.|{N} ({I})|Enter {I} in box {n1}.|We hold {I} on file for {N}.|Lost property: wallet with {I}.|I lost my papers, {I}.|Tenant: {N}, {I}, {A}.|Landlord {N}, {A}, tel. {P}.|Deliver to: {N}, {A}|The flat at {A} is free from {d}.|A fire was reported at {A} at {t}.|The garage lies at {A}; ring first.|"
    "Come to {A} at {t}, bring cake.|Send cheques to {N}, {A}.|Return to sender: {A}.|He lives at {A}.|Branch: {A}|In an emergency call {P}.|Dial {P} for the {role}.|Call me: {P}.|Landline {P}.|tel:{P}|WhatsApp {P}|Hotline {P} (free)|her number was {P} and not {P}|The caller left {P} and no name.|"
    "{T}{N} teaches the {W} class on {W}.|According to {N}, the {w} was {w}.|\"{W} {w} {w},\" said {N}.|{N} says: {w} {w}.|{N} wrote that the {w} {w} is {w}.|Photo: {N}|Directed by {N}, music by {N}.|A letter from {N} to {N}.|{N} owes {N} {money}.|Ask {N} about the {w}.|{N} has not replied to {E}.|@{G} can you ask {N}?|"
    "Approved: {N}|Witness: {N} / {N}|Signature: {N}|Signed for by {N} at {t}|Checked out to {N} until {d}|Keys returned by {N}.|Left with neighbour {N}, {A}.|Picked up by {T}{N}, {I}.|Visitor log: {N}, {t}, {I}|{t} {N} enters, {t} {N} leaves|Shift swap {N} -> {N}|{T}{N} phoned from {P}.|We met {T}{N} in {W}.|"
    "Sehr geehrte Frau {F},|Sehr geehrter Herr {F},|Liebe {G}, lieber {G},|Guten Tag {T}{N},|Mein Name ist {N}.|Ich heiße {N} und wohne in der {A}.|Wir sind umgezogen: {A}.|Postanschrift: {A}|Das Paket ging an {N}, {A}.|Tel.: {P}|Telefon {P}, Fax {P}|Handy: {P}|Ruf bitte {N} unter {P} zurück.|Unter {P} ist niemand zu erreichen.|"
    "Schreiben Sie an {E}.|Meine Mail ist {E}, danke!|E-Mail: {E}|Viele Grüße\n{N}|Hochachtungsvoll\n{N}\n{A}\n{P}|Mit besten Grüßen, {N}, {E}|{N} hat am {d} Geburtstag.|Unser {role} {N} kommt um {t}.|Die Schlüssel liegen bei {N}.|Laut {N} war {w} {w}.|Anwesend: {N}, {N} und {N}.|Versicherte Person: {N}, {I}|Seine {I}.|Bitte {I} angeben.|"
    "Mieterin {N}, geboren am {d}, {I}.|Vorgelegt wurde {I}.|Vermieter: {N}, {A}.|Name, Vorname: {N}|Abgeholt von {N}.|Unterschrift {N}|Die Wohnung in {A} ist ab {d} frei.|Kommt bitte um {t} zu {A}.|Vertretung: {T}{N} ({P})|{T}{N} ist heute krank.|"
    "Madame {F}, Monsieur {F},|Bonjour {N},|Chère {G}, cher {G},|Je m'appelle {N}.|J'habite au {A}.|Nouvelle adresse : {A}|Adresse : {A}|Le colis est pour {N}, {A}.|Tél. : {P}|Téléphone {P}|Portable : {P}, bureau : {P}.|Rappelle {N} au {P}.|Merci d'écrire à {E}.|Courriel : {E}|Mon mail : {E}|Bien à vous,\n{N}|Amitiés,\n{N}\n{A}\n{P}|"
    "{N} est né le {d}.|Notre {role}, {N}, passera à {t}.|Selon {N}, {w} {w}.|Présents : {N}, {N} et {N}.|Assurée : {N}, {I}.|Indiquez {I}.|Il a présenté {I}.|Locataire : {N}, {I}, {A}.|Nom et prénom : {N}|Remis à {N} le {d}.|L'appartement du {A} est libre.|Rendez-vous au {A} à {t}.|Signature : {N}|{T}{N} est absente aujourd'hui."
).split("|")
#: Everyday sentences without anything personal.
NEUTRAL = (
    "Your order {c} left the warehouse on {d}.|Invoice {c} over {money} is due on {d}.|Tracking code {c}.|Version {v} fixes {n} bugs.|Upgrade from {v} to {v} took {n} min.|The train leaves {W} at {t} from track {n1}.|Flight {code} to {W} is late.|Room {n} is on floor {n1}.|Seats {n}{l} and {n}{l} are taken.|Chapter {n1}, page {n}.|"
    "The {w} cost {money} in {W}.|{n} people voted, {n} did not.|Open {t} to {t}, closed on {W}.|See {url} for the {w} list.|Server {ip} did not answer at {t}.|Bake at {n} degrees for {n} minutes.|Mix {x} g of flour with {x} ml of milk.|The score was {n1}:{n1} ({n1}:{n1}).|Article {n1} ({n1}) applies.|ISBN {isbn}|Part {c} fits model {code}.|"
    "Serial number {c}, batch {c}.|Serial: {big}|S/N {code}, P/N {c}|Article no. {big}|Customer no. {big}|Case {c} was closed.|Contract {c} of {d}.|Account {big} has been credited.|Ticket #{big} is open.|Reference: {c}|Locker {n}, combination {n1}-{n1}-{n1}.|Bus {n} stops at {W} {st}.|{W} {st} is closed for works.|The {W} {st} market opens at {t}.|"
    "Works on {W} {st} end in {n} weeks.|Grid reference {n} {n}, height {n} m.|Coordinates {x}, {x}.|Ratio {x}/{x}.|Rated {n1}/{n1} by {n} readers.|Password hint: {w} {n}.|Use @{w} or #{w} in your post.|rate {n}@{n} is fine|{n} @ {x} each|chmod {n} {w}.py|{w}_{w}({n1}, {n1}) returns {w}|id={n}, {w}={x}|commit {hash}|{W} {c} {w} the {w} {w}.|{W} {c}|{w}: {c}|{w} no. {c}, {w} {c}|{W} {c} {w} {W} {c}.|{w} {w} {c}|[{w} {w} {w}]|[{w}]|({w} {w})|{w}_{w}_{w} {w} {w}.|{w}-{w}_{w}|{w} at {w} at {t}.|{w} dot {w}|{W} {n} {w} at {n} {w}.|{x} {w}, {x} {w}|{n} {W}, {n} {W}|{n} {W} {w}|{n1}. {W} {w} {w}|"
    "{F} {ep}s are sold out.|The {F} {ep} explains it.|A {F} {ep} with {n} turns.|Use the {F}-{F} {ep}.|{F} {F} {ep}|Read about the {F} {ep} on page {n}.|{F}'s {ep} holds here.|By the {F} {ep}, {w} is {w}.|We tried a {F} {ep} next to the {w}.|Another {F} {ep} was {w} at {n}.|{F} et al. disagree.|as in {F} ({n})|Compare {F} and {F} ({n}).|"
    "{F} {firm} opened in {W}.|{W} {firm} sold {n} shares.|{F} & {F} {firm}|Mr {F} was late.|Ms {F} and Mrs {F} agree.|Ask {G} for it.|{G} and {G} are coming.|Thanks {G}!|Dr {F} is away.|We drove from {W} to {W}.|The {W} team beat {W}.|{Ws}|{Ws}: {w} {w} {w}.|The {Ws} report is ready.|{Ws} ({n})|{n1}. {Ws}|"
    "Das {F}-{epde} wurde gelehrt.|Die {F}-{epde} ergibt {x}.|Nach dem {F}-{epde} sind es {n}.|Herr {F} kommt später.|Frau {F} ruft zurück.|Rechnung {c} über {money}.|Zug {n} nach {W} fällt aus.|Die {W}{dest} ist gesperrt.|Version {v} ist da.|Zimmer {n}, Etage {n1}.|Kundennummer {big}, Vorgang {c}.|Seite {n}, Absatz {n1}.|"
    "Geöffnet von {t} bis {t}.|Am {d} um {t} geht es los.|Artikelnummer {c}, Lager {n}.|Der Preis stieg um {x} %.|{n} Stück zu {money}.|"
    "La {epfr} de {F} est connue.|Le {epfr} {F} donne {x}.|On utilise la {epfr} {F}.|Madame {F} rappellera.|M. {F} est parti.|Facture {c} de {money}.|Le train {n} pour {W} est annulé.|La rue de {W} est barrée.|Version {v} disponible.|Chambre {n}, étage {n1}.|Dossier {c}, client {big}.|Page {n}, ligne {n1}.|"
    "Ouvert de {t} à {t}.|Le {d} à {t}, tout commence.|Référence {c}, rayon {n}.|Le prix a monté de {x} %.|{n} pièces à {money}."
).split("|")


@lru_cache(maxsize=4)
def vocabulary(paths=VOCABULARIES) -> tuple[list[str], list[str]]:
    """Lower-case and capitalised words of the named tokenizer files; none if they are not there."""
    low, high = set(), set()
    for p in paths:
        if Path(p).exists():
            for line in Path(p).read_bytes().splitlines():
                word = base64.b64decode(line.split()[0]).decode("utf-8", "ignore")
                if len(word) > 3 and word[0] == " " and word[1:].isalpha():
                    if word.islower():
                        low.add(word[1:])
                    elif word[2:].islower():
                        high.add(word[1:])
    latin = lambda s: sorted(w for w in s if max(w) < "ɐ")
    return latin(low), latin(high)


class Writer:
    """Writes texts; ``text, spans`` with spans as (start, end, type)."""

    def __init__(self, seed: int, paths=VOCABULARIES) -> None:
        self.r = random.Random(seed)
        self.low, self.high = vocabulary(paths)
        low, high = vocabulary(paths[:1])
        known = set(low)
        self.proper = [w for w in high if w.lower() not in known]  # never written small: mostly names

    def digits(self, shape: str) -> str:
        """'#' any digit, '%' 1-9, '@' a capital, others as they are."""
        r = self.r
        return "".join(str(r.randint(0, 9)) if c == "#" else str(r.randint(1, 9)) if c == "%" else r.choice("ABCDEFGHJKLMNPRSTUVWXYZ") if c == "@" else c for c in shape)

    def stem(self, n: int) -> str:
        r = self.r
        return "".join(r.choice(ONSET) + r.choice(VOWEL) + (r.choice(CODA) if r.random() < 0.55 else "") for _ in range(n))

    def simple(self) -> str:
        """A plain syllable."""
        r = self.r
        return r.choice("b d f g h k l m n p r s t v w br fr gr kr st tr el al or".split()) + r.choice("aaeeiioou") + r.choice("l l m n n r r s t d k v z nd rn lm st ld lk ".split(" "))

    def word(self) -> str:
        return self.r.choice(self.low) if self.low and self.r.random() < 0.93 else self.stem(self.r.choice([1, 2, 2, 3]))

    def capital(self) -> str:
        u = self.r.random()
        return self.town() if u < 0.2 else self.r.choice(self.high) if self.high and u < 0.75 else self.word().capitalize()

    def marked(self, s: str) -> str:
        """Now and then a letter with a mark of another language."""
        r = self.r
        if r.random() < 0.9:
            return s
        k = r.randrange(len(s))
        near = {"a": "áàâäãåăą", "e": "éèêëęě", "i": "íìîïı", "o": "óòôöõøő", "u": "úùûüůű", "c": "çćč", "s": "śšşß", "z": "źżž", "n": "ñńň", "l": "ł", "g": "ğ", "r": "ř", "y": "ý", "d": "đ"}
        c = s[k].lower()
        return s[:k] + (r.choice(near[c]).upper() if s[k].isupper() and c != "s" else r.choice(near[c])) + s[k + 1 :] if c in near else s

    def given(self) -> str:
        r = self.r
        u = r.random()
        if u < 0.4 or (u < 0.7 and not self.proper):
            return r.choice(GIVEN)
        if u < 0.7:
            return r.choice(self.proper)
        end = r.choice("a a e i o us in el an is ja ka y ette ine ric bert ald mir wen lin on ar as er".split())
        return self.marked(((self.simple() if r.random() < 0.8 else self.stem(1)) + end).capitalize())

    def single_family(self) -> str:
        r = self.r
        u = r.random()
        if u < 0.25 or (u < 0.5 and not self.proper):
            return r.choice(FAMILY)
        if u < 0.5:
            return r.choice(self.proper)
        if u < 0.52:
            return self.word().capitalize()
        if u < 0.56:
            return r.choice(["O'", "Mc", "Mac", "D'", "O’", "Fitz", "N'"]) + self.simple().capitalize() + r.choice(["", "", "y", "en", "er", "ey"])
        base = self.simple() if u < 0.84 else self.stem(1) if u < 0.9 else self.word() if u < 0.96 else self.simple() + self.simple()
        return self.marked((base + r.choice(FAMILY_END)).capitalize())

    def family(self) -> str:
        r = self.r
        u = r.random()
        f = self.single_family()
        if u < 0.05:
            f += "-" + self.single_family()
        return f

    def name(self) -> str:
        r = self.r
        g = self.given()
        if r.random() < 0.12:
            g += "-" + self.given()
        u = r.random()
        if u < 0.17:
            g = g[0] + "."
            if r.random() < 0.3:
                g += r.choice(["", " ", "-"]) + self.digits("@.")
        elif u < 0.29:
            g += " " + self.digits("@.")
        elif u < 0.37:
            g += " " + self.given()
        elif u < 0.4:
            g += " " + self.digits("@. @.")
        f = self.family()
        v = r.random()
        if v < 0.07:
            p = r.choice(PARTICLE)
            f = (p if r.random() < 0.8 else p.title()) + " " + f
        elif v < 0.11:
            f += " " + self.single_family()
        w = r.random()
        out = f"{f}, {g}" if w < 0.17 else f"{f} {g}" if w < 0.2 else f"{g} {f.upper()}" if w < 0.23 else f"{f.upper()}, {g}" if w < 0.25 else f"{g} {f}"
        return out.upper() if r.random() < 0.07 else out

    def email(self) -> str:
        r = self.r
        ascii_ = lambda s: re.sub(r"[^a-z]", "", s.lower().translate(str.maketrans("äöüéèáíóúñçłøå", "aoueeaiouncloa"))) or "x"
        g, f = ascii_(self.given()), ascii_(self.family())
        word = ascii_(self.word())
        local = r.choice([f"{g}.{f}", f"{f}.{g}", f"{f}_{g}", f"{g[0]}{f}", f"{g[0]}-{f}", f"{f}{r.randint(1, 99)}", f"{f}", f"{g[0]}.{f}", f"{g}{r.randint(1, 1999)}", f"{g}_{f}", f"{g}-{f}", f"{word}", f"{word}.{word}{r.randint(0, 99)}", f"{g}.{word}", f"{g}{f}", f"info.{word}", f"{word}_{f}"])
        if r.random() < 0.15:
            local += "+" + ascii_(self.word())
        if r.random() < 0.06:
            local = self.marked(local)
        if r.random() < 0.08:
            local = ".".join(p.capitalize() for p in local.split("."))
        host = [w for w in (r.choice(["", "", "", "mail", "post", "dept", ascii_(self.word())]), r.choice([self.stem(1), self.stem(2), ascii_(self.word()), ascii_(self.word()), ascii_(self.word()) + "-" + ascii_(self.word()), "gmail", "web", "outlook"])) if w]
        if r.random() < 0.05:
            host[-1] = self.marked(host[-1])
        host += r.choice([["example"], ["example", "org"], ["example", "com"], ["example", "net"], ["test"], ["invalid"], ["de"], ["fr"], ["com"], ["org"], ["net"], ["ch"], ["co", "uk"], ["ac", "uk"], ["edu"], ["eu"], ["io"]])
        style = r.random()
        at, dot = (
            ("@", ".") if style < 0.66 else (" @ ", ".") if style < 0.71 else ("(at)", ".") if style < 0.76 else (" [at] ", " [dot] ") if style < 0.82 else (" at ", " dot ") if style < 0.87 else ("[at]", "[dot]") if style < 0.9
            else (" (at) ", " (dot) ") if style < 0.93 else ("{at}", ".") if style < 0.94 else (" AT ", " DOT ") if style < 0.96 else ("(at)", "(dot)") if style < 0.98 else (" [at] ", ".")
        )
        out = local + at + dot.join(host)
        return out.upper() if r.random() < 0.06 else out

    def phone(self) -> str:
        r = self.r
        out = self.digits(
            r.choice(
                "+1 %##-###-####|+1 (%##) ###-####|+1 %## ### ####|+1-%##-###-####|1-%##-###-####|(%##) ###-####|(%##)###-####|%##-###-####|%##.###.####|%## ### ####|+44 %# #### ####|+44 (0)%# #### ####|+44 7### ######|+44%#########|0%# #### ####|0%### ######|07### ######|0%## ### ####|07#########|"
                "+33 % ## ## ## ##|+33 (0)% ## ## ## ##|+33%########|0033 % ## ## ## ##|0% ## ## ## ##|0%.##.##.##.##|0%-##-##-##-##|0%########|+49 %# ########|+49 %# ##### ###|+49 %## #######|+49 %## ### ## ##|+49 (0)%# #######|+49-%##-#######|+49%##########|+49/%#/######|0049 %# ########|0%# #######|0%#/#######|0%#/#####-###|"
                "0%## / ######|0%##-######|0%### ######|0%## #### ###|01## #######|01#########|+41 %# ### ## ##|0%# ### ## ##|+43 % ### ####|+43 %## ######|+34 %## ### ###|+39 0% #### ####|+31 % ########|+31 %# ### ####|+48 %## ### ###|+32 % ### ## ##|+46 %#-### ## ##|+420 %## ### ###|(0%#) #######|(0%##) ######|(0%#) #### ####|"
                "00%# %# ### ## ##|+%# %## ### ####|+%## %# ### ####|%##-####".split("|")
            )
        )
        if r.random() < 0.15:
            out += r.choice([" ext. ", " ext ", " x", "x", ", ext. ", " extension ", " Durchwahl ", " DW ", " poste ", ", poste ", " Apparat ", " ext.", " int. "]) + self.digits(r.choice(["#", "##", "###", "####"]))
        return out.replace(" ", "\u00a0") if r.random() < 0.07 else out

    def identity(self) -> tuple[str, str, str]:
        r = self.r
        number = self.digits(
            r.choice(
                "###-##-####|###-##-####|### ## ####|#########|##########|########|##.##.##-###.##|@@#######|@########|@#@##@###|@%@@#####|@#######|@##@#####|@@ ## ## ## @|@@######@|@@######|##@@#####|## ### ### ###|###########|##/###/#####|###/####/####|### ### ###|# ## ## ## ### ### ##|#############|% ## ## ## ### ###|## ###### @ ###|########@###|######-####|"
                "######-###-#|756.####.####.##|@-#######-@|########-@|########@|@#### #####|@@@######|@@@@@######@@#@@|##-#######|### #### ###|@@# ### ###|#### #### ####".split("|")
            )
        )
        label = (r.choice(LABELS) if r.random() < 0.6 else r.choice(LABEL_OF) + r.choice(LABEL_END)) + r.choice(AFTER_LABEL)
        if r.random() < 0.15:
            label = label[:1].upper() + label[1:]
        if r.random() < 0.1:
            label = label.upper() if r.random() < 0.5 else label.lower()
        if r.random() < 0.12:
            label = r.choice(["my ", "her ", "his ", "your ", "the ", "meine ", "Ihre ", "son ", "mon ", "votre ", "with ", "old ", "German ", "French ", "valid "]) + label
        return label, r.choice([" ", " ", " ", " ", " ", "", "\n"]) if label[-1] in ":#=" else "" if label[-1] in "(\n" else " ", number

    def town(self) -> str:
        r = self.r
        t = self.marked((self.stem(1) + r.choice(TOWN_END)).capitalize()) if r.random() < 0.7 or not self.high else r.choice(self.high)
        u = r.random()
        if u < 0.78:
            return t
        if u < 0.88:
            return r.choice(["Port", "Bad", "Neu", "Saint", "Alt", "Nord", "Sainte", "Groß", "Klein", "Ober", "Nieder", "Le", "La"]) + r.choice(["-", "-", " "]) + t
        if u < 0.95:
            return r.choice(["New", "Old", "East", "West", "North", "South", "Great", "Little", "St", "Mount", "Fort"]) + " " + t
        return t + r.choice([" am See", " an der Elbe", "-sur-Mer", "-le-Château", " upon Avon", " Springs", " Heights", "-les-Bains", " Falls", " City"])

    def address(self) -> str:
        r = self.r
        word = lambda: (self.word() if r.random() < 0.45 else self.stem(1) + r.choice(["er", "le", "y", "ton", "", "ing"])).capitalize() if r.random() < 0.8 else self.family()
        line = r.choice([", ", ", ", ", ", "\n", ",\n", " "]) if r.random() < 0.95 else " - "
        style = r.random()
        if style < 0.52:
            street = " ".join(word() for _ in range(r.choice([1, 1, 2, 2, 3])))
            number = f"{r.randint(1, 299 if r.random() < 0.8 else 9999)}{r.choice(['', '', '', '', 'a', 'b', 'A', 'B', ' C', '-' + str(r.randint(3, 99))])}"
            out = f"{number}{r.choice([' ', ' ', ' ', ' ', ', '])}{r.choice(['', '', '', '', '', 'N. ', 'West '])}{street} {r.choice(STREET_EN)}"
            flat = f"{r.choice(FLAT)} {r.randint(1, 60)}{r.choice(['', '', '', 'A', 'b'])}"
            if r.random() < 0.22:
                out = f"{flat}{r.choice([', ', ', ', ' '])}{out}"
            elif r.random() < 0.22:
                out += f"{r.choice([', ', ', ', ' '])}{flat}"
            post = r.choice(["", " #####", " #####", ", #####", f", {r.choice(STATES)} #####", f" {r.choice(STATES)} #####", ", @@ #####", " @@# #@@", " @# #@@", ", @@## #@@", " @#@ #@@", " #####-####", "\n@@# #@@", "\n#####"])
            out += line + self.town() + self.digits(post) if r.random() < 0.93 else ""
        elif style < 0.74:
            u = r.random()
            number = f"{r.randint(1, 250)}{r.choice(['', '', '', 'a', 'b', 'c', ' a', '-' + str(r.randint(2, 99)), '/' + str(r.randint(1, 9))])}"
            if u < 0.65:
                street = word() + r.choice(["", "", "", "er ", "-"]) + r.choice(STREET_DE)
                street = street if " " not in street and "-" not in street else street.rsplit(street[street.find(" ") if " " in street else street.find("-")], 1)[0] + (" " if " " in street else "-") + r.choice(STREET_DE_APART)
            elif u < 0.85:
                street = r.choice(["Am", "An der", "Zum", "Zur", "Im", "In der", "Auf dem", "Unter den", "Alter", "Hinter der"]) + " " + word()
            else:
                street = r.choice(["Alte", "Lange", "Neue", "Hohe", "Kurze", "Große"]) + " " + r.choice(STREET_DE_APART[:6])
            out = f"{street} {number}{line}{r.choice(['', '', '', '', 'D-', 'A-'])}{self.digits(r.choice(['#####', '#####', '#####', '####']))} {self.town()}" if r.random() < 0.93 else f"{street} {number}"
        elif style < 0.94:
            way = r.choice(STREET_FR)
            way = way if r.random() < 0.8 else way.capitalize()
            out = f"{r.randint(1, 250)}{r.choice(['', '', '', '', ' bis', ' ter', 'B'])}{r.choice([' ', ' ', ' ', ', '])}{way}{'' if way[-1] in chr(39) else ' '}{' '.join(word() for _ in range(r.choice([1, 1, 2])))}"
            if r.random() < 0.12:
                out = r.choice(["Bât. B, ", "Appt 12, ", "Résidence " + word() + ", ", "App. 4, "]) + out
            out += f"{line}{r.choice(['', '', '', '', 'F-'])}{self.digits('#####')} {self.town()}{r.choice(['', '', '', '', ' Cedex', ' Cedex 9'])}" if r.random() < 0.93 else ""
        else:
            out = f"{r.choice(STREET_OTHER)} {word()}{r.choice([' ', ', ', ' n.º '])}{r.randint(1, 250)}{line}{self.digits('#####')} {self.town()}"
        return out.upper() if r.random() < 0.04 else out

    def date(self) -> str:
        r = self.r
        y, m, d = r.randint(1930, 2031), r.randint(1, 12), r.randint(1, 28)
        return r.choice([f"{y}-{m:02d}-{d:02d}", f"{d:02d}.{m:02d}.{y}", f"{d}.{m}.{y}", f"{d:02d}/{m:02d}/{y}", f"{m}/{d}/{y % 100:02d}", f"{d} {r.choice(MONTHS)} {y}", f"{d}. {r.choice(MONTHS)} {y}", f"{r.choice(MONTHS)} {d}, {y}", f"{r.choice(MONTHS)} {d}", f"{d}.{m}."])

    def slot(self, key: str) -> str:
        r = self.r
        return {
            "n": lambda: str(r.randint(0, 9999) if r.random() < 0.4 else r.randint(0, 999)), "n1": lambda: str(r.randint(0, 9)), "x": lambda: f"{r.random() * r.choice([1, 50, 900]):.{r.randint(1, 4)}f}".replace(".", r.choice(".....,")),
            "d": self.date, "t": lambda: r.choice([f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", f"{r.randint(1, 12)} pm", f"{r.randint(0, 23)}h{r.randint(0, 59):02d}", f"{r.randint(0, 23)}.{r.randint(0, 59):02d} Uhr", f"{r.randint(0, 23)}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}"]),
            "c": lambda: self.digits(r.choice(["###-####-##", "@-####", "@########", "@@-###", "####-##", "@##-####", "##/#####", "@@@-##-####", "########", "###-###-###", "##-###-###", "20##-#####", "#-###-@", "@@##.###", "###.###", "####-####-####", "##-###-##", "###-#######", "@-##-@", "@@@@-####"])),
            "code": lambda: self.digits(r.choice(["@##@#", "@@###", "@##", "##@##", "@@####", "@-##", "@@@##", "@#@#", "###@", "@@-##@"])), "big": lambda: self.digits(r.choice(["%######", "%#########", "%########", "%###########", "%#####", "%# ####", "%## ### ###", "00%######"])),
            "v": lambda: ".".join(str(r.randint(0, 30)) for _ in range(r.choice([2, 3, 3, 4]))), "l": lambda: r.choice("ABCDEF"), "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
            "money": lambda: r.choice([f"€{r.randint(1, 9999)}", f"{r.randint(1, 999)},{r.randint(0, 99):02d} €", f"${r.randint(1, 999)}.{r.randint(0, 99):02d}", f"{r.randint(1, 99)}.{r.randint(100, 999)},00 EUR", f"£{r.randint(1, 99)}", f"CHF {r.randint(1, 999)}.-"]),
            "isbn": lambda: self.digits("978-#-###-#####-#"), "hash": lambda: f"{r.getrandbits(r.choice([32, 64, 128])):08x}", "url": lambda: r.choice(["https://", "www.", "http://"]) + self.word() + "." + r.choice(["org", "com", "de", "fr"]) + r.choice(["", "/" + self.word(), f"/{self.word()}?id={r.randint(1, 9999)}"]),
            "F": self.family, "G": self.given, "T": lambda: r.choice(TITLES), "w": self.word, "W": self.capital, "Ws": lambda: " ".join(self.word().capitalize() for _ in range(r.choice([2, 2, 3, 4]))), "role": lambda: r.choice(ROLE),
            "ep": lambda: r.choice(EPONYM) if r.random() < 0.5 else self.word(), "epde": lambda: r.choice(EPONYM_DE), "epfr": lambda: r.choice(EPONYM_FR), "firm": lambda: r.choice(FIRM), "st": lambda: r.choice(STREET_EN), "dest": lambda: r.choice(STREET_DE),
        }[key]()

    def fill(self, template: str) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans = "", []
        for part in re.split(r"(\{\w+\})", template):
            key = part[1:-1] if part.startswith("{") else None
            kind = {"E": "email", "P": "phone", "A": "address", "N": "name"}.get(key)
            if kind:
                s = getattr(self, kind)()
                spans.append((len(out), len(out) + len(s), kind))
            elif key == "I":
                label, gap, s = self.identity()
                out += label + gap
                spans.append((len(out), len(out) + len(s), "id_number"))
            else:
                s = self.slot(key) if key else part
            out += s
        return out, spans

    def words(self, n: int, join: list[str], german: bool) -> list[str]:
        """A run of words, joined as in a sentence; German ones with capitals among them."""
        r = self.r
        out: list[str] = []
        for _ in range(n):
            w = r.choice(join) if r.random() < 0.45 else self.word()
            lone = not out or out[-1][0].islower()  # two capitals in succession would look like a name
            out.append(w.capitalize() if lone and w not in join and r.random() < (0.5 if german else 0.03) else w)
        return out

    def filler(self) -> str:
        """A sentence of any words; capitals, numbers and codes among them."""
        r = self.r
        lang = r.choice([0, 0, 1, 2])
        words = self.words(r.randint(2, 16), JOIN[lang], lang == 1)
        for k in range(len(words)):
            u = r.random()
            if u < 0.09:
                words[k] = self.slot(r.choice(["n", "x", "c", "c", "code", "n1", "big", "d", "t"]))
            elif u < 0.1 and words[k - 1][0].islower() and words[(k + 1) % len(words)][0].islower():
                words[k] = self.capital()
            elif u < 0.15:
                words[k] += ","
        u = r.random()
        if u < 0.1:
            return " ".join(words)
        out = " ".join([words[0][:1].upper() + words[0][1:], *words[1:]])
        return (out.upper() if u < 0.16 else out) + r.choice([".", ".", ".", "!", "?", ":", ";", ""])

    def carried(self) -> tuple[str, list[tuple[int, int, str]]]:
        """What is personal in a written sentence, or among any words, so that no one phrase is needed beside it."""
        r = self.r
        if r.random() < 0.4:
            template = r.choice(CARRIERS)
        else:
            piece = r.choice(["{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{N}", "{T}{N}", "{role} {N}", "{W}: {N}", "{n1}. {N}", "{N} - {w}", "{N}'s {w}", "{N}'s", "{E}", "{P}", "{P}", "{A}", "{A}", "{I}", "{I}", "{I}", "{N} ({E})", "{N}, {P}", "{N}, {I}", "{P} / {E}", "{N} and {N}", "{N}, {A}"])
            lang = r.choice([0, 0, 1, 2])
            before, after = (" ".join(self.words(r.choice([0, 0, 1, 2, 3, 4, 6, 9]), JOIN[lang], lang == 1)) for _ in range(2))
            before = before[:1].upper() + before[1:] if r.random() < 0.8 else before
            if r.random() < 0.18:
                before = (before + " " + self.word().capitalize()).strip()
            template = f"{before}{r.choice([' ', ' ', ' ', ' ', ' ', ': ', ', ', ' (']) if before else ''}{piece}{r.choice([' ', ' ', ' ', ' ', ', ', '; ', ') ', ' - ']) if after else ''}{after}{r.choice(['.', '.', '.', '', '!', ';'])}"
        if r.random() < 0.06:  # a line in capitals
            s, spans = self.fill(template)
            return (s.upper(), spans) if len(s.upper()) == len(s) else (s, spans)
        return self.fill(template)

    def sentence(self) -> tuple[str, list[tuple[int, int, str]]]:
        r = self.r
        u = r.random()
        if u < 0.58:
            return self.carried()
        if u < 0.78:
            s, _ = self.fill(r.choice(NEUTRAL))
            return (s.upper() if r.random() < 0.03 else s), []
        return self.filler(), []

    def text(self, least: int) -> tuple[str, list[tuple[int, int, str]]]:
        out, spans = "", []
        while len(out) < least:
            s, found = self.sentence()
            spans += [(a + len(out), z + len(out), k) for a, z, k in found]
            out += s + self.r.choice([" ", " ", " ", " ", " ", "\n", "\n\n", "  ", "\n- "])
        if self.r.random() < 0.04:
            out = out.replace(" ", "\u00a0")
        return out, spans
