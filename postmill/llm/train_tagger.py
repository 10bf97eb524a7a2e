"""Makes labelled text for problem 4, and trains the character LSTM and the scorer that read no text any more (``train_reader`` trains what does): python -m postmill.llm.train_tagger POSTS.parquet OUT.npz [ROUNDS [WEIGHTS]].

Spans come from formats and name lists, the words around them from cues, leads and tails in six languages, all of them written for this
module; some clauses without spans and a few names were added after wrong findings on test posts were read. ``HELD_OUT`` has sentences of other wording that training never sees; ``held_out`` reports
the recall of each kind in each language on them. At most 20,000 sentences of posts (``carriers``) without long numbers, at-signs or pairs of capitals
serve as text around the made sentences. With WEIGHTS, training goes on from there at a lower rate.
"""

from __future__ import annotations

import random
import re
import sys

import numpy as np

from postmill.llm.tagger import KINDS, WIDTH, encode, fit_scorer, new_weights, train

# Given names, family names and name parts from several regions.
GIVEN = "Anna Maria Paul Peter Laura Lukas Julia Sophie Carlos Lucia Marco Giulia Pedro Ines Joao Rui Hugo Marie Pierre Camille Jean Luc Emma Noah Liam Olivia Ethan Grace Henry Alice Oscar Clara Jonas Felix Nina Sara David Daniel Elena Irene Pablo Javier Sofia Matteo Chiara Luca Paolo Tiago Beatriz Anton Birgit Ravi Arjun Noor Leila Omar Elif Emeka Amara Yuki Mei Chen Ivan Olga Pilar Maya Ruth Karl Greta Jürgen Zoë André Renée José Núria Mónica Åsa Søren Fatima Hassan Kwame Thabo Dmitri Katarzyna Piotr Zsófia Mehmet Aisha Tomás Heike Uwe Dieter Claire Benoît Nicola Fabio Gonçalo Rafael Megan Declan Aoife Hiroshi Linh Minh Sunita Deepak Ingrid Astrid Kerstin Torsten Jörg Stefan Andreas Monika Sabine Petra Manuel Miguel Antonio Carmen Rosa Teresa Diego Sergio Raquel Marta Philippe Nicolas Isabelle Nathalie Céline Julien Francesca Giovanni Roberto Alessandro Valentina Simone João Ana Catarina Filipe Nuno Robert Michael James William Thomas Susan Margaret Jessica Brian Kevin Yusuf Ahmed Khadija Kofi Sanjay Anjali Rahul Wei Xin Sakura Mateo Dario Klara".split()
FAMILY = "Smith Jones Brown Taylor Wilson Clark Müller Schmidt Weber Fischer Wagner Becker García López Martínez Sánchez Romero Martin Bernard Dubois Moreau Laurent Rossi Russo Ferrari Bianchi Romano Silva Santos Ferreira Pereira Oliveira Costa Kumar Patel Singh Khan Yilmaz Okafor Tanaka Wang Kowalski Novak Ivanov Jensen Larsen Berg Murphy O'Brien D'Angelo Petrov Nagy Haddad Mensah Dlamini Tran Pham Sharma Iyer Venkataraman Fernandes Carvalho Conti Greco Lefèvre Girard Zimmermann Hoffmann".split()
SYLLABLES = "bra ken dor vel tor wex nav sul yar ost zim gren hal mas qui rul den dry vik gard lin sen ova rro rud tor mi das fel kor nel pra stu wen cal ber ran dil ist ton ley ham bor ash mund stein hof rich wald ra gu na than esh wari kov ski ez ini etti eau".split()
WORDS = "sun river apple green tiger cloud north paper stone happy blue lemon music coffee garden silver winter book sky fox bird tree light moon".split()

# What leads to a span of each kind, by language; {} is the span.
CUES = {
    "en": {
        "E": "email me at {}|drop me a line: {}|you will find me under {}|forward everything to {}|my address for mail is {}|replies to {} only|I registered with {}|the login was {}|questions? {}|get in touch via {}|E-mail: {}|she gave out {} as her contact",
        "P": "ring me at {}|my mobile: {}|give me a bell on {}|the number I left was {}|reach me by phone on {}|Phone {}|mobile {}|you can dial {}|WhatsApp {}|tel {}|a text to {} will do|my landline {} is dead|dial {} now|they called from {}|the number {}|saved {} as spam|voicemail at {}",
        "I": "social security no. {}|my passport number, {},|passport: {}|the tax office knows me as {}|national insurance number {}|ID card no. {}|my SSN is {}|tax number {}|NI no. {}|identity number: {}|driver ID {} of mine|insured under {}|it shows {} as my ID|a copy of my ID, {}|my ID number {} leaked|passport {} expired",
        "A": "deliver to {}|we moved to {}|our house at {}|my place is {}|pick it up from {}|the invoice says {}|ship to: {}|home address {}|right next to {}|come by, {}|the van stopped at {}|we are at {}|outside {}|at {} since spring|in front of {}|between here and {}|a flat in {}|the door of {}",
        "N": "my name is {}|my name is {}|I am {}|this is {} speaking|a man named {}|{} was lovely|the agent {} helped|regards, {}|{} from support|ask {} about it|my neighbour {}|thank you {}|{} took my call|written by {}|best wishes, {}|a lady called {}|{} signed for it|my wife {}|{} told us|with {} lately|because {} said so|for {} only|to {} directly|we met {} there|{} called back|that {} is great|between {} and me|{}, my boss,|name: {}",
    },
    "de": {
        "E": "mailt mir an {}|erreichbar bin ich über {}|alles bitte an {}|E-Mail: {}|registriert bin ich mit {}|meine Mail lautet {}|Rückfragen an {}|angemeldet unter {}|Kontakt {}",
        "P": "ruf mich an: {}|Handy {}|mobil {}|ihr erreicht mich unter der {}|Tel.: {}|die Rufnummer {} gehört mir|Festnetz {}|meine Handynummer ist {}|Rückruf bitte an {}|Fon {}|wählt {}|sie riefen von {} an|die Nummer {}|Anrufbeantworter unter {}",
        "I": "Steuer-ID {}|Steuernummer {}|Personalausweis {}|Ausweis-Nr. {}|Sozialversicherungsnummer {}|Passnummer {}|meine Krankenversichertennummer {}|Pass {}|Rentenversicherungsnummer: {}|darauf steht {} als Ausweisnummer|eine Kopie vom Pass {}|meine Steuernummer {} ist bekannt",
        "A": "wohnhaft {}|liefert bitte in die {}|mein Haus steht in der {}|Anschrift: {}|abzuholen bei {}|wir sind umgezogen, {}|das Paket liegt {}|zu Hause: {}|Rechnung an {}|vor {}|in der {} seit Mai|eine Wohnung {}|bis zur {}|gegenüber {}",
        "N": "mein Name ist {}|mein Name ist {}|ich bin {}|ich heiße {}|Gruß, {}|mit freundlichen Grüßen {}|{} vom Kundendienst|ein Herr namens {}|Frau {} war nett|mein Kollege {}|danke an {}|Ihre {}|{} hat unterschrieben|unser Nachbar {}|laut {}|geschrieben von {}|{} sagte uns|mit {} neulich|weil {} das sagte|nur für {}|direkt an {}|wir trafen {}|{} rief zurück|zwischen {} und mir|Name: {}",
    },
    "es": {
        "E": "mi email es {}|podéis responder a {}|contacto: {}|escribe a {}|registrado con {}|correo electrónico {}|mandadlo todo a {}|dudas a {}|la cuenta {} es mía",
        "P": "mi móvil es {}|llamad al {}|teléfono: {}|tel. {}|mi número de contacto, {}|por WhatsApp al {}|me localizan en el {}|fijo {}|marcad el {}|marca {}|llamaron desde {}|el número {}|buzón en el {}",
        "I": "mi DNI {}|NIE {}|pasaporte número {}|número de la seguridad social {}|mi NIF es {}|documento nacional {}|pasaporte {}|identificación fiscal {}|cédula {}|sale {} como mi documento|una copia del pasaporte {}|mi DNI, {}, quedó a la vista",
        "A": "vivimos en {}|mi casa está en {}|entregar en {}|dirección: {}|domicilio {}|recogida en {}|nos mudamos a {}|enviadlo a {}|mi piso, {},|delante de {}|en {} desde mayo|un piso en {}|hasta {}|enfrente de {}",
        "N": "me llamo {}|me llamo {}|soy {}|mi nombre: {}|atentamente, {}|un tal {}|{} fue muy amable|me atendió {}|gracias a {}|la señora {}|mi vecino {}|{} de atención al cliente|saludos, {}|según {}|hablé con {}|firmó {}|{} nos dijo|con {} hace poco|porque {} lo dijo|solo para {}|vimos a {}|{} devolvió la llamada|entre {} y yo|nombre: {}",
    },
    "fr": {
        "E": "mon mail : {}|répondez à {}|mon adresse mail est {}|contact {}|inscrit avec {}|e-mail : {}|tout envoyer à {}|questions à {}|joignable via {}",
        "P": "mon portable est le {}|téléphone : {}|tél. {}|rappelez au {}|joignable au {}|mon fixe, le {}|appelez le {}|WhatsApp {}|un SMS au {} suffit|composez le {}|ils ont appelé du {}|le numéro {}|messagerie au {}",
        "I": "numéro de sécu {}|mon numéro de passeport {}|passeport n° {}|carte d'identité {}|numéro fiscal de référence {}|mon NIR est {}|identifiant fiscal {}|sécurité sociale : {}|on y lit {} comme identité|une copie du passeport {}|mon numéro de sécu, {}, est visible",
        "A": "nous habitons {}|livrez au {}|adresse : {}|ma maison se trouve {}|domicilié {}|à retirer au {}|nous avons déménagé au {}|mon appartement, {},|facture envoyée au {}|devant le {}|au {} depuis mai|un appartement {}|jusqu'au {}|en face du {}",
        "N": "je m'appelle {}|je m'appelle {}|je suis {}|mon nom est {}|cordialement, {}|une certaine {}|{} a été charmante|j'ai parlé avec {}|merci à {}|monsieur {}|ma voisine {}|{} du service client|selon {}|bien à vous, {}|écrit par {}|{} nous a dit|avec {} récemment|parce que {} l'a dit|pour {} seulement|on a vu {}|{} a rappelé|entre {} et moi|nom : {}",
    },
    "it": {
        "E": "la mia mail: {}|rispondete a {}|email {}|contatto: {}|registrato con {}|mandate tutto a {}|domande a {}|posta elettronica {}|mi trovate su {}",
        "P": "il mio cellulare è {}|telefono: {}|tel. {}|chiamate il {}|fisso {}|richiamatemi allo {}|raggiungibile al {}|WhatsApp {}|un SMS al {}|fate il {}|hanno chiamato dal {}|il numero {}|segreteria allo {}",
        "I": "codice fiscale {}|il mio passaporto numero {}|carta d'identità {}|passaporto: {}|C.F. {}|tessera sanitaria {}|documento {}|numero di previdenza sociale {}|si legge {} come documento|una copia del passaporto {}|il mio codice fiscale, {}, si vede",
        "A": "abitiamo in {}|consegnare in {}|indirizzo: {}|casa mia è in {}|residente in {}|ritiro in {}|ci siamo trasferiti in {}|il mio appartamento, {},|fattura a {}|davanti a {}|in {} da maggio|un alloggio in {}|fino a {}|di fronte a {}",
        "N": "mi chiamo {}|mi chiamo {}|sono {}|il mio nome è {}|cordiali saluti, {}|un certo {}|{} è stata gentilissima|ho parlato con {}|grazie a {}|la signora {}|il mio vicino {}|{} dell'assistenza|secondo {}|distinti saluti {}|scritto da {}|{} ci ha detto|con {} di recente|perché {} lo ha detto|solo per {}|abbiamo visto {}|{} ha richiamato|tra {} e me|nome: {}",
    },
    "pt": {
        "E": "meu e-mail: {}|respondam para {}|contato: {}|email {}|registado com {}|mandem tudo para {}|dúvidas para {}|correio eletrónico {}|cadastrado como {}",
        "P": "meu celular é {}|telefone: {}|tel. {}|telemóvel {}|me liguem no {}|fixo {}|contacto {}|WhatsApp {}|um SMS para o {}|disque {}|ligaram do {}|o número {}|caixa postal no {}",
        "I": "meu CPF é {}|NIF {}|passaporte número {}|RG {}|cartão de cidadão {}|segurança social {}|passaporte: {}|documento {}|contribuinte n.º {}|aparece {} como documento|uma cópia do passaporte {}|o meu CPF, {}, ficou à vista",
        "A": "vivemos na {}|entregar na {}|endereço: {}|a minha casa fica na {}|morada: {}|retirada em {}|mudámos para a {}|meu apartamento, {},|fatura para {}|em frente à {}|na {} desde maio|um apartamento na {}|até à {}|ao lado da {}",
        "N": "chamo-me {}|meu nome é {}|chamo-me {}|meu nome é {}|sou {}|o meu nome: {}|atenciosamente, {}|um tal de {}|{} foi muito gentil|falei com {}|obrigado a {}|a senhora {}|o meu vizinho {}|{} do apoio ao cliente|segundo {}|cumprimentos, {}|escrito por {}|{} disse-nos|com {} há pouco|porque {} disse|só para {}|vimos {}|{} ligou de volta|entre {} e mim|nome: {}",
    },
}
# What stands before and after such a clause.
AROUND = {
    "en": ("Honestly, |For the record, |If anyone cares, |Still waiting; |As I told them, |Hi all, |PS: |Update: |||||", ".|!| - thanks.|, please.| and nothing happened.| since last year.| (again).|, as always.| but nobody reacted.| for three days.| and I would like to know why.| who never called back.| on Monday.| because of that.| and then it was gone| but I never got a reply.|||"),
    "de": ("Ehrlich gesagt, |Zur Info: |Nur so viel: |Hallo zusammen, |Nachtrag: |Wie gesagt, |||||", ".|!|, danke.|, aber nichts passiert.| seit Mai.| (schon wieder).|, wie immer.| und keiner meldet sich.| und ich wüsste gern warum.| am Montag.| und das war's.| obwohl ich gefragt hatte.| weil es dringend war.|||"),
    "es": ("La verdad, |Para que conste, |Hola a todos, |Como dije, |Nota: |||||", ".|!|, gracias.| y nada.| desde mayo.| (otra vez).|, como siempre.| pero nadie responde.| y quiero saber por qué.| el lunes.| porque era urgente.| aunque pregunté.|||"),
    "fr": ("Franchement, |Pour info, |Bonjour à tous, |Comme je disais, |PS : |||||", ".|!|, merci.| et rien.| depuis mai.| (encore).|, comme toujours.| mais personne ne réagit.| et je voudrais savoir pourquoi.| lundi dernier.| parce que c'était urgent.| alors que j'avais demandé.|||"),
    "it": ("Sinceramente, |Per la cronaca, |Ciao a tutti, |Come dicevo, |Nota: |||||", ".|!|, grazie.| e niente.| da maggio.| (di nuovo).|, come sempre.| ma nessuno risponde.| e vorrei sapere perché.| lunedì scorso.| perché era urgente.| anche se avevo chiesto.|||"),
    "pt": ("Sinceramente, |Para constar, |Olá a todos, |Como eu disse, |Nota: |||||", ".|!|, obrigado.| e nada.| desde maio.| (de novo).|, como sempre.| mas ninguém responde.| e queria saber porquê.| na segunda-feira.| porque era urgente.| embora tenha perguntado.|||"),
}
# Clauses with what is easily taken for a span; letters name what ``Maker.fill`` puts in.
OTHERS = {
    "en": "my order {o} is lost|parcel {o} went missing|the {m} makes noise|serial number {o}|invoice no. {o}|{h} posted about it|see {l}|{g} was kind|the shop on {s}|the branch in {T}|{b} sold it to me|I paid {p}|on {d} at {z}|{n} stars|the {b} app|{b} and {b}|firmware {v}|room {n}, floor {n}|the road to {T}|{T} is far|ask {g} or {g}|ticket {o}|version {v} of {b}|flight {m}|from {n} to {n} people|{b} {m} review|{y} was better|page {n} of {n}|Happy {w} everyone|read the {w} {w} guide|won {n}-{n}|batteries last {n} hours|model {m}{m}|bank transfer {o}|the {T} {w} centre|tell {g} hello|hi {g}|dear {g}|meet {g} there|with {g} gone|call {g} back|{b} told me to wait|{b} closes after {n} days|at {b} nobody cares|since {b} answered|late in {M}|early {M} {y}|{n} minutes at half past {n}|met at {T}|see you at the {T} outlet|look at {b}|waited {n} days at {T}|got {n} of {n} right at last|{w} {w} jacket|limited {w} edition {y}",
    "de": "meine Bestellung {o} fehlt|Sendungsnummer {o}|das {m} brummt|Seriennummer {o}|Rechnung Nr. {o}|{h} schrieb darüber|siehe {l}|{g} war nett|der Laden in der {t}|die Filiale in {T}|{b} hat es verkauft|kostet {p}|am {d} um {z}|{n} Sterne|die App von {b}|Vorgang {o}|Version {v}|das neue {b} {m}|Frau {f} war nett|der Herr {f} nicht|Zimmer {n}|Modell {m}|Der Kundendienst schweigt|Das Gerät von {b}|Die Hotline in {T}|{n} von {n} Punkten|Ende {M2}|Anfang {M2}|Mitte {M2} {y}|hallo {g}|liebe {g}|frag {g}|{b} antwortet nicht|bei {b} in {T}|nach {n} Tagen|die {w}-{w} Tasche",
    "es": "mi pedido {o} no llega|seguimiento {o}|el {m} hace ruido|número de serie {o}|factura {o}|{h} lo contó|mirad {l}|{g} fue amable|la tienda de la {c}|la oficina de {T}|{b} me lo vendió|cuesta {p}|el {d} a las {z}|{n} estrellas|la app de {b}|versión {v}|el {b} {m}|incidencia {o}|señor {f}|habitación {n}|modelo {m}|hola {g}|pregunta a {g}|{b} no contesta|tras {n} días en {T}|{b} cierra en {n} días",
    "fr": "ma commande {o} est perdue|suivi {o}|le {m} fait du bruit|numéro de série {o}|facture {o}|{h} en a parlé|voir {l}|{g} était gentil|la boutique de la {r}|l'agence de {T}|{b} me l'a vendu|coûte {p}|le {d} à {z}|{n} étoiles|l'appli {b}|version {v}|le {b} {m}|dossier {o}|madame {f}|chambre {n}|modèle {m}|salut {g}|demande à {g}|{b} ne répond pas|après {n} jours à {T}|{b} ferme dans {n} jours",
    "it": "il mio ordine {o} è perso|spedizione {o}|il {m} fa rumore|numero di serie {o}|fattura {o}|{h} ne ha parlato|vedi {l}|{g} è stato gentile|il negozio di {w2}|la filiale di {T}|{b} me l'ha venduto|costa {p}|il {d} alle {z}|{n} stelle|l'app {b}|versione {v}|il {b} {m}|pratica {o}|signora {f}|camera {n}|modello {m}|ciao {g}|chiedi a {g}|{b} non risponde|dopo {n} giorni a {T}|{b} chiude tra {n} giorni",
    "pt": "meu pedido {o} sumiu|rastreio {o}|o {m} faz barulho|número de série {o}|fatura {o}|{h} comentou|vejam {l}|{g} foi gentil|a loja da {u}|a agência de {T}|{b} me vendeu|custa {p}|em {d} às {z}|{n} estrelas|o app da {b}|versão {v}|o {b} {m}|processo {o}|dona {f}|quarto {n}|modelo {m}|oi {g}|pergunta à {g}|{b} não responde|depois de {n} dias em {T}|{b} fecha em {n} dias",
}
# Sentences for testing only, of other wording than the cues.
HELD_OUT = {
    "en": {"E": "If that fails there is always {}, I check it daily.|The receipt went to {} by mistake.", "P": "Nobody picked up when I left {} on their machine.|For refunds they want {} on file, so there it is.", "I": "The clerk typed {} from my passport into the system.|My social security card reads {} and they photographed it.", "A": "A courier left the box in the rain outside {} yesterday.|Our family has lived at {} for ages.", "N": "Yesterday {} finally repaired the heater.|The letter was addressed to {} and opened."},
    "de": {"E": "Die Quittung ging aus Versehen an {} raus.|Sonst gibt es noch {}, das lese ich täglich.", "P": "Auf dem Band habe ich {} hinterlassen.|Für die Erstattung wollten sie {} als Nummer.", "I": "Im Formular war mein Pass mit {} schon eingetragen.|Die Steuer-ID {} steht offen im Brief.", "A": "Der Bote stellte den Karton bei {} in den Regen.|Seit Jahren lebt meine Familie in der {}.", "N": "Gestern hat {} endlich die Heizung repariert.|Der Brief war an {} gerichtet."},
    "es": {"E": "El recibo llegó por error a {} ayer.|Si no, siempre queda {}, lo miro a diario.", "P": "Dejé {} en el contestador y nada.|Para devolver el dinero querían {} de contacto.", "I": "El empleado copió {} de mi pasaporte.|Mi DNI con {} salía en la foto.", "A": "El repartidor dejó la caja en {} bajo la lluvia.|Mi familia lleva años en {}.", "N": "Ayer {} arregló por fin la caldera.|La carta iba dirigida a {} y llegó abierta."},
    "fr": {"E": "Le reçu est parti par erreur à {} hier.|Sinon il reste {}, je le lis chaque jour.", "P": "J'ai laissé {} sur leur répondeur.|Pour le remboursement ils voulaient {} comme numéro.", "I": "L'employé a recopié {} de mon passeport.|Ma carte de sécurité sociale porte {} en clair.", "A": "Le livreur a laissé le carton devant {} sous la pluie.|Ma famille vit depuis des années au {}.", "N": "Hier {} a enfin réparé le chauffage.|La lettre était adressée à {} et ouverte."},
    "it": {"E": "La ricevuta è finita per errore a {} ieri.|Altrimenti resta {}, lo leggo ogni giorno.", "P": "Ho lasciato {} in segreteria.|Per il rimborso volevano {} come recapito.", "I": "L'impiegato ha copiato {} dal mio passaporto.|Il codice fiscale {} era in chiaro.", "A": "Il corriere ha lasciato la scatola davanti a {} sotto la pioggia.|La mia famiglia vive da anni in {}.", "N": "Ieri {} ha finalmente riparato la caldaia.|La lettera era indirizzata a {} e aperta."},
    "pt": {"E": "O recibo foi por engano para {} ontem.|Senão resta {}, leio todos os dias.", "P": "Deixei {} na secretária eletrónica.|Para o reembolso queriam {} como contato.", "I": "O funcionário copiou {} do meu passaporte.|O CPF {} aparecia em claro.", "A": "O estafeta deixou a caixa à porta da {} à chuva.|A minha família vive há anos na {}.", "N": "Ontem {} finalmente consertou o aquecedor.|A carta era dirigida a {} e veio aberta."},
}
STREET = {
    "en": "Street St St. Road Rd Rd. Avenue Ave Ave. Lane Ln Terrace Drive Close Court Square Way Crescent Hill Place Gardens Grove Walk".split(), "de": "straße strasse str. weg allee platz gasse ring ufer damm steig".split(),
    "es": ["Calle", "C/", "Avenida", "Avda.", "Plaza", "Paseo", "Camino", "Ronda", "Av."], "fr": ["rue", "avenue", "boulevard", "chemin", "place", "quai", "allée", "impasse", "bd", "cours"],
    "it": ["Via", "Viale", "Piazza", "Corso", "Vicolo", "Largo", "Strada", "V."], "pt": ["Rua", "Avenida", "Travessa", "Praça", "Largo", "R.", "Alameda", "Av."],
}

# More given names of many regions, from general knowledge.
GIVEN += "Aaron Abdul Ada Adam Adele Adriana Agnes Agnieszka Aiko Alan Albert Alejandro Aleksandra Alex Alexander Alfonso Alfred Ali Alina Amelia Amina Amir Amit Amy Andrea Andrew Angela Angelo Anita Anja Anke Annika Antoine Anya Ariel Armando Arthur Asha Ashley Aurora Ava Ayesha Barbara Bastian Beata Ben Benedikt Benjamin Bernd Bianca Bogdan Boris Brenda Bruno Caio Caleb Carla Carlo Carol Caroline Catherine Cecilia Charles Charlotte Chloe Christian Christine Claudia Colin Connor Cristina Damian Daniela Danilo Daria Davide Deborah Denis Denise Diana Dirk Dominik Donna Dorothea Duarte Eduardo Edward Eleanor Elias Elisa Elizabeth Ella Emil Emilia Emily Emmanuel Enrico Enzo Eric Erik Erika Esther Eva Evan Fabian Farah Federico Fernanda Fernando Filip Fiona Florian Frances Francisco Franco Frank Franz Freya Frida Gabriel Gabriela George Georg Gerald Gianna Gisela Giuseppe Gloria Gregor Guilherme Gustavo Hana Hannah Hans Harald Harry Heather Hector Heidi Helen Helena Helga Henrik Hermann Ian Ibrahim Igor Imran Inga Irina Isaac Isabel Ismael Ivana Jack Jacob Jakob Jan Jana Jane Janet Jason Jasmin Jennifer Jens Jin Joana Joaquín Johan Johanna John Jorge Joseph Joshua Josefine Juan Judith Jun Kaito Karen Karim Karin Katja Katrin Keiko Kenji Kiran Klaus Konrad Kristina Lars Lea Leandro Leo Leon Leonie Lena Leticia Lina Linda Lisa Lorenzo Louis Louise Lorena Lucas Luigi Luis Luisa Luka Lydia Magda Magnus Malik Manuela Marcel Marcos Marek Margarida Mariana Marina Mario Marion Mark Markus Martha Martina Mary Mathilde Matthias Mauro Max Melanie Mia Mina Mira Mohamed Moritz Nadia Naoki Natalia Nathan Neil Nicole Nikolai Nils Nora Norbert Oliver Otto Ousmane Patricia Patrick Paula Paulo Philip Priya Qing Rachel Ralf Ramón Rania Rebecca Renata Ricardo Richard Rita Rosie Roland Rolf Romain Ryan Salma Samira Samuel Sandra Sandro Sarah Sebastian Selma Sergei Silke Silvia Sina Stefania Stephan Stella Steven Sven Svenja Sylvie Tamara Tania Tanja Tariq Tatiana Theo Thiago Tim Tobias Tom Tomoko Toni Ulrike Ursula Valeria Vanessa Vera Veronica Victor Victoria Vikram Vincent Viktor Vivian Walter Wanda Wolfgang Xavier Yara Yasmin Ying Yves Zainab Zoe Zofia".split()
# Nouns for numbers of each kind (O: numbers of no kind), and what surrounds a noun {n} and its number {} of any kind, so that the noun and the format tell the kind and the wording does not.
NOUNS = {
    "en": {"P": "phone|phone number|mobile|mobile number|cell|landline|number|home phone|work phone|fax", "I": "passport|passport number|national ID|ID|ID card|ID number|social security number|SSN|tax ID|tax number|tax reference|driving licence|driver's license|insurance number|national insurance number|NHS number|Aadhaar|Aadhaar number|identity card|health card|residence permit|PAN", "O": "order|order number|parcel|parcel number|tracking|tracking number|shipment|lot|batch|serial|serial number|model|invoice|ticket|case|case number|booking|reference|voucher code|item|part number|customer number|contract|transaction|coupon|delivery|receipt"},
    "de": {"P": "Telefon|Telefonnummer|Handy|Handynummer|Mobilnummer|Nummer|Festnetz|Durchwahl|Rufnummer", "I": "Pass|Reisepass|Passnummer|Ausweis|Ausweisnummer|Personalausweis|Personalausweisnummer|Steuer-ID|Steuernummer|Sozialversicherungsnummer|Rentenversicherungsnummer|Krankenversichertennummer|Versichertennummer|Führerschein|Führerscheinnummer|Identifikationsnummer|Aufenthaltstitel", "O": "Bestellung|Bestellnummer|Sendung|Sendungsnummer|Paket|Paketnummer|Charge|Seriennummer|Modell|Rechnung|Ticket|Vorgang|Buchung|Gutschein|Artikelnummer|Kundennummer|Vertrag|Lieferung|Auftrag|Beleg"},
    "es": {"P": "teléfono|móvil|número|número de teléfono|fijo|celular|WhatsApp|número de móvil", "I": "pasaporte|número de pasaporte|DNI|NIE|NIF|documento de identidad|documento|carné de identidad|número de la seguridad social|seguridad social|cédula|identificación fiscal|CURP|RUT|permiso de conducir|tarjeta sanitaria|número fiscal", "O": "pedido|número de pedido|envío|seguimiento|paquete|lote|serie|número de serie|modelo|factura|incidencia|reserva|referencia|cupón|artículo|contrato|cliente|entrega|ticket|recibo"},
    "fr": {"P": "téléphone|portable|numéro|numéro de téléphone|fixe|mobile|ligne directe", "I": "passeport|numéro de passeport|carte d'identité|numéro d'identité|pièce d'identité|numéro de sécurité sociale|numéro de sécu|sécurité sociale|numéro fiscal|identifiant fiscal|NIR|permis de conduire|titre de séjour|carte vitale|carte nationale d'identité", "O": "commande|numéro de commande|colis|suivi|numéro de suivi|envoi|lot|série|numéro de série|modèle|facture|ticket|dossier|réservation|référence|bon|article|contrat|client|livraison|reçu"},
    "it": {"P": "telefono|cellulare|numero|numero di telefono|fisso|recapito telefonico", "I": "passaporto|numero di passaporto|carta d'identità|codice fiscale|documento|documento d'identità|tessera sanitaria|patente|numero della patente|permesso di soggiorno|numero di previdenza sociale|numero fiscale", "O": "ordine|numero d'ordine|spedizione|tracciamento|pacco|lotto|serie|numero di serie|modello|fattura|pratica|prenotazione|riferimento|buono|articolo|contratto|cliente|consegna|biglietto|ricevuta"},
    "pt": {"P": "telefone|celular|telemóvel|número|número de telefone|fixo|WhatsApp", "I": "passaporte|número do passaporte|CPF|RG|NIF|cartão de cidadão|bilhete de identidade|documento de identidade|documento|segurança social|número da segurança social|contribuinte|carta de condução|identidade|INSS|título de residência|número fiscal", "O": "pedido|número do pedido|encomenda|envio|rastreio|pacote|lote|série|número de série|modelo|fatura|processo|reserva|referência|cupom|artigo|contrato|cliente|entrega|bilhete|recibo"},
}
FRAMES = {
    "en": "my {n} {}|my {n} is {}|{n} {}|{n}: {}|{n} no. {}|the {n}, {}, is known|they wanted my {n} so they got {}|{n} {} was visible to everyone|she has my {n} {}|{n} {} and nothing else|why does {n} {} turn up here|{} as {n}|{} is my {n}|look up {n} {}|about {n} {} nobody knows anything|he read out my {n} {} aloud|on it stood my {n} {}|{n} {} leaked|{n} {} is lost|for my {n} I typed {}|the form has {n} {} on it|I had to give {n} {} twice|{n} {} again|a page with {n} {} in plain sight|{n} number {}",
    "de": "meine {n} {}|mein {n} ist {}|{n} {}|{n}: {}|{n} Nr. {}|die {n}, {}, ist bekannt|sie wollten meine {n}, also {}|{n} {} war für alle sichtbar|er hat meine {n} {}|{n} {} und sonst nichts|warum taucht {n} {} hier auf|{} als {n}|{} ist meine {n}|zu {n} {} weiß keiner etwas|er las meine {n} {} laut vor|darauf stand meine {n} {}|{n} {} ist durchgesickert|{n} {} ist weg|als {n} tippte ich {}|meine {n} {} wurde weitergegeben|im Formular steht {n} {}|{n} {} fehlt",
    "es": "mi {n} {}|mi {n} es {}|{n} {}|{n}: {}|{n} n.º {}|el {n}, {}, ya se sabe|querían mi {n} y les di {}|{n} {} a la vista de todos|tiene mi {n} {}|{n} {} y nada más|por qué aparece el {n} {} aquí|{} como {n}|{} es mi {n}|del {n} {} nadie sabe nada|leyó mi {n} {} en voz alta|ponía mi {n} {}|se filtró el {n} {}|el {n} {} se perdió|de {n} escribí {}|en el impreso sale el {n} {}",
    "fr": "mon {n} {}|mon {n} est {}|{n} {}|{n} : {}|{n} n° {}|le {n}, {}, est connu|ils voulaient mon {n}, alors {}|{n} {} visible par tous|il a mon {n} {}|{n} {} et rien d'autre|pourquoi {n} {} apparaît ici|{} comme {n}|{} est mon {n}|sur {n} {} personne ne sait rien|il a lu mon {n} {} à voix haute|il y avait mon {n} {}|{n} {} a fuité|la {n} {} est perdue|pour {n} j'ai mis {}|sur le papier, {n} {}",
    "it": "il mio {n} {}|il mio {n} è {}|{n} {}|{n}: {}|{n} n. {}|il {n}, {}, è noto|volevano il mio {n} e ho dato {}|{n} {} visibile a tutti|ha il mio {n} {}|{n} {} e nient'altro|perché compare {n} {} qui|{} come {n}|{} è il mio {n}|del {n} {} nessuno sa niente|ha letto il mio {n} {} ad alta voce|c'era scritto il mio {n} {}|{n} {} è trapelato|il {n} {} è perso|come {n} ho messo {}|sul modulo c'è {n} {}",
    "pt": "meu {n} {}|meu {n} é {}|{n} {}|{n}: {}|{n} n.º {}|o {n}, {}, é conhecido|queriam o meu {n} e dei {}|{n} {} à vista de todos|ele tem o meu {n} {}|{n} {} e mais nada|por que aparece {n} {} aqui|{} como {n}|{} é o meu {n}|do {n} {} ninguém sabe nada|leu o meu {n} {} em voz alta|estava escrito o meu {n} {}|vazou o {n} {}|o {n} {} sumiu|como {n} pus {}|no formulário está {n} {}",
}
# Sentences around phone numbers, addresses, e-mails and names without a noun for them, made of a beginning and an end.
LOOSE = {
    "en": {"P": "call|phone me on|they keep calling|stop texting|someone dialled|I answered|a call from|try|best after noon:|she rang from|reach us at|still getting calls on", "A": "it went to|deliver it to|they sent it to|the driver went to|I live at|we rent|the box is at|bring it back to|the bill went to|wrong house:|come and look:|not far from|my parents live at|it was left at", "E": "mail|write to|send it to|reply to|ask|the account is under|everything goes to|cc|it was sent from|pm me or", "N": "I talked to|thanks to|it was signed by|a colleague,|ask for|I know|the bill is made out to|according to|nobody but|a visit from|I blame|the technician,|we met|they passed me on to|yours,|complaint handled by", "end": "|!| twice| and waited| but no answer| instead of the right one| even after I said no| if you still have it| when you can| for a week now| who was patient| explained the rest| never replied| was rude to me| came by yesterday| fixed it in minutes| please"},
    "de": {"P": "ruft an:|ständig Anrufe auf|bitte nur|jemand wählte|Rückruf unter|am besten abends:|versucht es unter|es klingelt dauernd unter", "A": "es ging an|liefert es an|der Fahrer war in der|ich wohne|wir mieten|die Kiste steht|bringt es zurück in die|die Rechnung ging an|falsches Haus:|kommt vorbei:|nicht weit von|abgestellt wurde es", "E": "schreibt an|schickt es an|antwortet an|mein Konto läuft unter|alles geht an|Kopie an|es kam von", "N": "ich sprach mit|dank|unterschrieben von|ein Kollege,|fragt nach|ich kenne|die Rechnung lautet auf|laut|niemand außer|Besuch von|der Techniker,|wir trafen|man verband mich mit|eure|bearbeitet von|auch", "end": "|!| zweimal| und gewartet| aber keine Antwort| statt an die richtige| obwohl ich nein sagte| wenn ihr ihn noch habt| seit einer Woche| war geduldig| hat den Rest erklärt| hat nie geantwortet| war unhöflich| kam gestern vorbei| hat es gerichtet| bitte"},
    "es": {"P": "llamad:|llaman sin parar al|solo por las tardes:|alguien marcó|contesté al|una llamada del|probad en el|sigue sonando el", "A": "fue a parar a|llevadlo a|el conductor fue a|vivo en|alquilamos en|la caja está en|devolvedlo a|la factura llegó a|casa equivocada:|pasad a ver:|cerca de|lo dejaron en", "E": "escribid a|mandadlo a|responded a|la cuenta está a nombre de|todo va a|copia a|llegó desde", "N": "hablé con|gracias a|lo firmó|un compañero,|preguntad por|conozco a|la factura va a nombre de|según|nadie salvo|una visita de|el técnico,|vimos a|me pasaron con|vuestra,|lo gestionó|también", "end": "|!| dos veces| y esperé| pero nada| en vez del correcto| aunque dije que no| si aún lo tenéis| desde hace una semana| fue paciente| explicó lo demás| nunca respondió| fue grosero| vino ayer| lo arregló| por favor"},
    "fr": {"P": "appelez :|ils appellent sans arrêt le|plutôt le soir :|quelqu'un a composé le|un appel du|essayez le|ça sonne encore au", "A": "c'est parti au|livrez-le au|le chauffeur est allé au|j'habite|nous louons|le carton est au|rapportez-le au|la facture est arrivée au|mauvaise maison :|venez voir :|pas loin du|déposé au", "E": "écrivez à|envoyez-le à|répondez à|le compte est au nom de|tout part à|copie à|reçu de", "N": "j'ai eu|grâce à|signé par|un collègue,|demandez|je connais|la facture est au nom de|d'après|personne sauf|une visite de|le technicien,|on a croisé|on m'a passé|votre|traité par|aussi", "end": "|!| deux fois| et attendu| sans réponse| au lieu du bon| alors que j'ai dit non| si vous l'avez encore| depuis une semaine| a été patient| a expliqué le reste| n'a jamais répondu| était impoli| est passé hier| l'a réparé| s'il vous plaît"},
    "it": {"P": "chiamate:|chiamano di continuo il|meglio la sera:|qualcuno ha fatto il|una chiamata dal|provate al|squilla ancora lo", "A": "è finito in|portatelo in|l'autista è andato in|abito in|affittiamo in|la scatola è in|riportatelo in|la fattura è arrivata in|casa sbagliata:|venite a vedere:|vicino a|lasciato in", "E": "scrivete a|mandatelo a|rispondete a|il conto è a nome di|tutto va a|copia a|arrivato da", "N": "ho sentito|grazie a|firmato da|un collega,|chiedete di|conosco|la fattura è intestata a|secondo|nessuno tranne|una visita di|il tecnico,|abbiamo incontrato|mi hanno passato|vostra|gestito da|anche", "end": "|!| due volte| e ho aspettato| senza risposta| invece di quello giusto| anche se ho detto no| se l'avete ancora| da una settimana| è stato paziente| ha spiegato il resto| non ha mai risposto| è stato scortese| è passato ieri| l'ha riparato| per favore"},
    "pt": {"P": "liguem:|ligam sem parar para|melhor à noite:|alguém marcou|uma chamada do|tentem o|ainda toca o", "A": "foi parar à|levem para|o motorista foi à|moro na|alugamos na|a caixa está na|devolvam na|a fatura chegou à|casa errada:|venham ver:|perto da|deixado na", "E": "escrevam para|mandem para|respondam a|a conta está em nome de|tudo vai para|cópia para|veio de", "N": "falei com|graças a|assinado por|um colega,|perguntem por|conheço|a fatura está em nome de|segundo|ninguém exceto|uma visita de|o técnico,|encontramos|passaram-me a|vossa|tratado por|também", "end": "|!| duas vezes| e esperei| sem resposta| em vez do certo| embora eu tenha dito não| se ainda o tiverem| há uma semana| foi paciente| explicou o resto| nunca respondeu| foi grosseiro| passou ontem| consertou| por favor"},
}
# More clauses without spans: counts and times of things, brands and towns as actors, days.
PLAIN = {
    "en": "it took {n} hours|{n} times last {w}|after {n} days|{n} answers about {b}|last {w} {b} rang|the {m} of {b} has {n} parts|Another {w} from {b}|{b} says no|an intern at {b} told me|{b} and {T} again|in {T} the {w} broke|ask {b}|the store of {T}|{n} minutes from {T}|powered by {b}|people in {T}|dear {b}|hi {g}|with {g} only|{s} is closed|all of {s}", "de": "es dauerte {n} Stunden|{n} Mal im {M2}|nach {n} Tagen|{n} Antworten zu {b}|das {m} von {b} hat {n} Teile|{b} sagt nein|ein Praktikant von {b} sagte das|in der Filiale {T}|in {T} ging es kaputt|fragt {b}|{n} Minuten bis {T}|Leute aus {T}|Hallo {g}|nur mit {g}|die {t} ist gesperrt",
    "es": "tardó {n} horas|{n} veces en mayo|a los {n} días|{n} respuestas sobre {b}|el {m} de {b} tiene {n} piezas|{b} dice que no|un becario de {b} lo dijo|la tienda de {T}|en {T} se rompió|preguntad a {b}|a {n} minutos de {T}|hola {g}|solo con {g}|la {c} está cerrada", "fr": "il a fallu {n} heures|{n} fois en mai|après {n} jours|{n} réponses sur {b}|le {m} de {b} a {n} pièces|{b} dit non|un stagiaire de {b} l'a dit|le magasin de {T}|à {T} il a cassé|demandez à {b}|à {n} minutes de {T}|bonjour {g}|avec {g} seulement|la {r} est fermée",
    "it": "ci sono volute {n} ore|{n} volte a maggio|dopo {n} giorni|{n} risposte su {b}|il {m} di {b} ha {n} pezzi|{b} dice no|uno stagista di {b} lo ha detto|il negozio di {T}|a {T} si è rotto|chiedete a {b}|a {n} minuti da {T}|ciao {g}|solo con {g}|{w2} è chiusa", "pt": "levou {n} horas|{n} vezes em maio|após {n} dias|{n} respostas sobre {b}|o {m} da {b} tem {n} peças|{b} diz que não|um estagiário da {b} disse|a loja de {T}|em {T} quebrou|perguntem à {b}|a {n} minutos de {T}|oi {g}|só com {g}|a {u} está fechada",
}


class Maker:
    """Random spans and what is easily taken for them."""

    def __init__(self, seed: int, more: bool = False, plain: list[str] | None = None):
        self.r, self.more, self.plain = random.Random(seed), more, plain

    def word(self, lo=2, hi=3):
        r = self.r
        if self.plain and r.random() < 0.6:  # a word of the text around, or two halves of them
            a, b = r.choice(self.plain), r.choice(self.plain)
            return (a if r.random() < 0.35 else a[: len(a) // 2 + 1] + b[(len(b) + 1) // 2 :]).capitalize()
        return "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(lo, hi))).capitalize()

    def digits(self, pattern: str) -> str:
        return "".join(str(self.r.randint(0, 9)) if c == "9" else self.r.choice("ABCDEFGHJKLMNPRSTXYZQ") if c == "A" else c for c in pattern)

    def E(self, lang):  # noqa: N802
        r = self.r
        part = lambda: r.choice([r.choice(WORDS), self.word(1, 2).lower(), r.choice(GIVEN).lower(), r.choice(FAMILY).lower()])
        local = [part()] + [part() for _ in range(r.random() < 0.6)] + [str(r.randint(1, 999))] * (r.random() < 0.3)
        domain = [part() + r.choice(["", "", "mail", "post", "box", "net"])] + r.choice([[], [], [part()]]) + [r.choice("com de org es fr it net test example invalid com.br co.uk pt eu io".split())]
        domain = ".".join(domain).split(".")
        form = r.random()
        if form < 0.45:
            out = r.choice("._-+").join(local) if r.random() < 0.7 else "".join(local)
            out += "@" + ".".join(domain)
        else:
            at_word, dot_word = {"en": ("at", "dot"), "de": (r.choice(["at", "ät", "klammeraffe"]), r.choice(["punkt", "Punkt", "dot"])), "es": (r.choice(["arroba", "at"]), "punto"), "fr": (r.choice(["arobase", "at", "chez"]), "point"), "it": (r.choice(["chiocciola", "at"]), "punto"), "pt": (r.choice(["arroba", "at"]), "ponto")}[lang]
            at = r.choice([f" {at_word} ", f" ({at_word}) ", f"({at_word})", f"[{at_word}]", f" [{at_word}] ", " @ ", " (@) ", f" {{{at_word}}} ", f" {at_word.upper()} ", f"_{at_word}_", f" <{at_word}> "])
            dot = r.choice([".", ".", f" {dot_word} ", f"({dot_word})", f" [{dot_word}] ", f"[{dot_word}]", " . ", f" ({dot_word}) "])
            out = r.choice([".", "_", dot if len(dot) > 2 else ".", ""]).join(local) + at + dot.join(domain)
        out = out.upper() if r.random() < 0.08 else out.title() if r.random() < 0.03 else out
        return r.choice(["", "", "", "", "mailto:", "<"]) + out

    def P(self, lang):  # noqa: N802
        r = self.r
        if r.random() < 0.25:
            sep = r.choice(" -./ ")
            groups = r.choice([(3, 3, 4), (3, 4), (2, 2, 2, 2, 2), (3, 3, 3), (3, 2, 2, 2), (4, 6), (4, 3, 3), (2, 4, 4), (5, 6), (3, 5, 3), (3, 2, 2), (2, 3, 2, 2), (4, 7), (3, 7), (2, 5, 4), (5, 4), (4, 4), (10,), (9,), (11,)])
            body = sep.join("9" * g for g in groups)
            head = r.choice(["", "", "", "+9 ", "+99 ", "+999 ", "0099 ", "+99", "(099) ", "+99 (0)", "0", "(99) ", "1-", "+1 ", "1 "])
            return self.digits(head + body).strip()
        own = {
            "en": "+1 (999) 555-9999|999-555-9999|(999) 555-9999|1.999.555.9999|+44 20 7946 0999|01632 960 999|07700 900999|020 7946 0999|+44 (0)1632 960999|+353 20 915 9999|555-9999|555 9999|1-800-555-9999",
            "de": "030 23125 999|+49 30 23125-999|0171 3920999|0049 (0)69 90009 999|089/99998999|+49 (0)171 39209 99|(030) 23125999|+43 1 9999999|0151-99999999|040 66969 999",
            "es": "+34 699 999 999|699 99 99 99|91 999 99 99|699999999|0034 699 999 999|93 999 99 99|+34 91 999 99 99|+52 55 9999 9999|955 555 999",
            "fr": "01 99 00 99 99|06.39.98.99.99|+33 6 39 98 99 99|+33 (0)1 99 00 99 99|0199009999|07-39-98-99-99|0033 1 99 00 99 99|02 61 91 99 99",
            "it": "+39 06 9999 9999|06 5559999|349 999 9999|3499999999|+39 349 9999999|02/5559999|0039 02 99999999|055 999 9999",
            "pt": "+351 919 999 999|919 999 999|21 999 99 99|(11) 95555-9999|+55 11 99999-9999|11 5555-9999|919999999|(21) 99999 9999|00351 21 999 9999",
        }[lang]
        return self.digits(r.choice(own.split("|")))

    def I(self, lang):  # noqa: E743, N802
        passport = "A9999999|AA9999999|999999999|A99999999|99AA99999|AA999999|C99A99A99|AAA999999|A999999AA"
        own = {
            "en": "999-99-9999|999 99 9999|QQ 99 99 99 A|QQ999999A|999999999|999-999-999|AB 99 99 99 C|99999 99999", "de": "99 999 999 999|99999999999|99/999/99999|99 999999 A 999|A999999999|99999999A999|999/999/9999|L99A99A999", "es": "99999999A|99999999-A|A9999999A|X-9999999-A|99.999.999-A|99/99999999/99|X9999999A|9.999.999",
            "fr": "9 99 99 99 999 999 99|999999999999999|1 99 99 99 999 999|2999999999999|99 99 999 999 999|99AA99999|999999999999", "it": "AAAAAA99A99A999A|AAA AAA 99A99 A999A|AA9999999|CA99999AA|AAAAAA 99A99 A999A|AA99999AA", "pt": "999.999.999-99|99999999999|999 999 999|999999999|99.999.999-9|99999999 9 ZZ9|AA999999|99999999999",
        }[lang]
        return self.digits(self.r.choice((own if self.r.random() < 0.75 else passport).split("|")))

    def A(self, lang):  # noqa: N802
        r = self.r
        n, name, town = str(r.randint(1, 299)), r.choice(self.plain).capitalize() if self.plain and r.random() < 0.4 else self.word(), self.word()
        if r.random() < 0.3:
            name = r.choice([f"{name} {self.word()}", r.choice(FAMILY), f"{r.choice(GIVEN)} {r.choice(FAMILY)}", r.choice(WORDS).capitalize()])
        n += r.choice(["", "", "", "", "a", "B", " b", "/2", "-3"])
        zip_, s = self.digits(r.choice(["99999", "9999", "9999-999"])), r.choice(STREET[lang])
        if lang == "en":
            out = r.choice([f"{n} {name} {s}", f"{n} {name} {s}", f"{n}, {name} {s}", f"No. {n}, {name} {s}", f"Flat {r.randint(1, 30)}, {n} {name} {s}", f"{n} {name} {s}, Apt {r.randint(1, 40)}", f"Unit {r.randint(1, 9)}/{n} {name} {s}"])
            out += r.choice(["", "", f", {town}", f", {town} {zip_}"])
        elif lang == "de":
            glue = r.choice(["", "", "-", " "]) if " " not in name else r.choice(["-", " "])
            street = name + (s if glue == "" else glue + s.capitalize())
            out = f"{r.choice([street, street, street, name + 'damm', 'Am ' + name, 'Unter den ' + name, 'Alte ' + name + 'gasse', name + 'er ' + s.capitalize()])} {n}" + r.choice(["", "", f", {town}", f", {zip_} {town}"])
        elif lang == "fr":
            of = r.choice(["", "", "du ", "de la ", "des ", "de ", "d'"])
            out = f"{n}{r.choice(['', '', ',', ' bis', ' ter,'])} {s} {of}{name}" + r.choice(["", "", f", {town}", f", {zip_} {town}", f" {zip_} {town}"])
        else:
            of = r.choice(["", "", "", "de ", "del ", "da ", "dos "]) if lang != "it" else r.choice(["", "", "", "del ", "San ", "dei "])
            out = f"{s}{'' if s == 'C/' and r.random() < 0.5 else ' '}{of}{name}{r.choice([' ', ' ', ', ', ', nº ', ' n. ', ' número '])}{n}"
            out += r.choice(["", "", f", {town}", f", {zip_} {town}", f", {r.randint(1, 9)}º {r.choice('ABCD')}" if lang != "it" else f", {zip_} {town}"])
        return out.lower() if r.random() < 0.15 else out.upper() if r.random() < 0.03 else out

    def family(self):
        r = self.r
        one = r.choice(FAMILY) if r.random() < 0.3 else self.word(2, 4)
        return one + "-" + self.word(2, 3) if r.random() < 0.12 else one

    def N(self, lang):  # noqa: N802
        r = self.r
        g = r.choice(GIVEN) if r.random() < (0.86 if self.more else 0.92) else self.word(1, 3)
        f = self.family()
        out = r.choice([f"{g} {f}"] * 8 + [f"{g} {r.choice('ABCDEHJKLMRST')}. {f}", f"{f}, {g}", f"{g} {r.choice(GIVEN)} {f}", f"{g}-{r.choice(GIVEN)} {f}", f"{g} {r.choice(['de', 'da', 'van', 'von', 'di', 'del', 'dos', 'bin', 'al', 'le'])} {f}", f"{g} {f} {self.family()}", f"{r.choice('ABCDEHJKLMRST')}. {g} {f}"])
        return out.upper() if r.random() < 0.05 else out.lower() if r.random() < (0.14 if self.more else 0.07) else out

    def brand(self):
        r, name = self.r, self.word()
        return r.choice([name, f"{name} & {self.word()}", f"{name}-{self.word()}", f"{name} {r.choice('Labs Mobile Home Foods Motors Bank Outdoor Air Energy Telecom Fitness Systems Kitchen Audio Sports Group Insurance'.split())}", f"{name} {self.word()}", f"{name} {r.randint(2, 99)}", f"{name} {r.randint(2, 99)}", f"{name}{r.randint(2, 99)}", f"{name}.{r.choice(['com', 'io'])}", f"{r.choice(WORDS)}{name.lower()}", f"{r.choice(WORDS).capitalize()} & {r.choice(WORDS).capitalize()}", f"{r.choice(WORDS).capitalize()}{name}", f"{r.choice(WORDS).capitalize()} {r.choice(WORDS).capitalize()}"])

    def fill(self, c: str) -> str:
        r = self.r
        name = self.word()
        return {
            "o": lambda: self.digits(r.choice(["9999-9999-999", "9999 9999 9999", "999999999999", "ZX999999999Q", "AA999999999AA", "99999999", "1Z99999999", "999-9999999-9999999", "#999999", "A-99999", "999999", "AAA-9999-99", "9999999", "RE-2099-9999", "99-9999", "99999-99", "JJD9999999999", "SN99A9999", "999999999999999999"])),
            "m": lambda: self.digits(r.choice(["AA-999", "A999", "AA999", "AA-9999", "999A", "A99", "AA99A"])), "v": lambda: self.digits(r.choice(["9.9.9999", "2.9.9", "10.9.99", "v9.9"])), "h": lambda: "@" + r.choice([*WORDS, name.lower()]) + r.choice(["", "_", ""]) + str(r.randint(0, 99)),
            "l": lambda: r.choice(["https://", "www.", "http://"]) + f"{name.lower()}{r.randint(1, 99)}.example/{self.word().lower()}/{r.randint(1000, 99999)}", "g": lambda: r.choice(GIVEN), "f": lambda: r.choice(FAMILY) if r.random() < 0.5 else self.word(2, 4), "s": lambda: f"{name} {r.choice(STREET['en'])}", "t": lambda: name + r.choice(STREET["de"]),
            "c": lambda: f"{r.choice(STREET['es']).lower()} {name}", "r": lambda: f"{r.choice(STREET['fr'])} {name}", "w2": lambda: f"{r.choice(STREET['it'])} {name}", "u": lambda: f"{r.choice(STREET['pt'])} {name}", "w": lambda: r.choice(WORDS).capitalize(), "b": self.brand,
            "p": lambda: r.choice(["$9", "£99.50", "45,90 €", "€237", "314 euros", "1.299,00 €", "$1,299"]), "d": lambda: self.digits(r.choice(["12/09/2023", "2023-09-19", "9 May 2023", "19.09.2023", "3. Mai"])), "z": lambda: self.digits(r.choice(["19:99", "9 pm", "19h99"])), "n": lambda: str(r.randint(2, 299)),
            "T": lambda: r.choice([name, name, f"{r.choice(['Bad', 'San', 'New', 'Porto', 'Saint', 'Santa', 'Los', 'Upper', 'Castel'])} {name}", f"{name}-{self.word()}", f"{name} am {self.word()}", f"{name}, {self.word()}"]), "y": lambda: str(r.randint(2015, 2024)), "M": lambda: r.choice("January February March April June July August September October November December".split()), "M2": lambda: r.choice("Januar Februar März April Juni Juli August September Oktober November Dezember".split()),
        }[c]()

    def clause(self, lang: str, kind: str | None) -> tuple[str, list[int]]:
        r = self.r
        if kind is None:
            return (x := re.sub(r"\{(\w+)\}", lambda m: self.fill(m.group(1)), r.choice(OTHERS[lang].split("|")))), [0] * len(x)
        before, after = r.choice(CUES[lang][kind].split("|")).split("{}")
        if r.random() < 0.15:
            before, after = r.choice([("", ""), ("(", ")"), (": ", ""), ("- ", ""), ("", ","), ("\n", "\n"), ("/ ", "")])
        span, k = getattr(self, kind)(lang), "EPIAN".index(kind)
        if len(before) + len(after) < 4 and kind in "PI":  # without words around it, the format alone must tell
            while not (re.match(r"[+(]|00|0\d", span) if kind == "P" else re.search(r"[A-Z]\w*\d|\d[A-Z]|^\d{3}-\d\d-\d{4}$|\.\d{3}-\d\d$", span)):
                span = getattr(self, kind)(lang)
        return before + span + after, [0] * len(before) + [1 + 2 * k] + [2 + 2 * k] * (len(span) - 1) + [0] * len(after)

    def framed(self, lang: str, kind: str | None) -> tuple[str, list[int]]:
        """A clause made of parts, in which nouns of all kinds of numbers stand in the same places."""
        r = self.r
        if kind is None and r.random() < 0.4:
            return (x := re.sub(r"\{(\w+)\}", lambda m: self.fill(m.group(1)), r.choice(PLAIN[lang].split("|")))), [0] * len(x)
        if kind in (None, "P", "I") and (kind != "P" or r.random() < 0.5):
            before, after = r.choice(FRAMES[lang].split("|")).replace("{n}", r.choice(NOUNS[lang][kind or "O"].split("|"))).split("{}")
        else:
            before, after = r.choice(LOOSE[lang][kind].split("|")) + " ", r.choice(LOOSE[lang]["end"].split("|"))
        span, k = getattr(self, kind)(lang) if kind else self.fill("o"), "EPIAN".find(kind or "-")
        if kind == "I" and r.random() < 0.2:
            span = self.digits(r.choice(["9999 9999 9999", "999999999999", "9999-9999-9999", "999999999"]))
        elif kind == "P" and r.random() < 0.15:
            span = self.digits(r.choice(["9999999999", "999 9999", "999-9999", "99999999999", "999999999"]))
        if kind == "N" and r.random() < 0.12:  # a name at the beginning
            before = ""
        return before + span + after, [0] * len(before) + ([1 + 2 * k] + [2 + 2 * k] * (len(span) - 1) if kind else [0] * len(span)) + [0] * len(after)

    def part(self, lang: str, kind: str | None) -> tuple[str, list[int]]:
        return (self.framed if self.more and self.r.random() < 0.6 else self.clause)(lang, kind)

    def sentence(self, spans: float = 0.55) -> tuple[str, list[int]]:
        r, lang = self.r, self.r.choice(list(CUES))
        text, tags = self.part(lang, r.choice("EPIAN") if r.random() < spans else None)
        lead, tail = (r.choice(x.split("|")) for x in AROUND[lang])
        if r.random() < 0.25:
            more, marks = self.part(lang, r.choice("EPIAN") if r.random() < spans else None)
            glue = r.choice([", ", "; ", " - ", ". ", " / "])
            text, tags = text + glue + more, tags + [0] * len(glue) + marks
        if not lead and text[0].islower() and not tags[0] and r.random() < 0.8:
            text = text[0].upper() + text[1:]
        text, tags = lead + text + tail, [0] * len(lead) + tags + [0] * len(tail)
        return text, tags


def carriers(path: str, most: int = 20_000, seed: int = 5) -> list[str]:
    """At most ``most`` sentences of posts that hold no at-sign, no long number, no number beside a capital, no given name and, but for German, no pair of capitals other than at their start."""
    import pyarrow.parquet as pq

    out: list[str] = []
    odd = re.compile(r"@|\bat\b|\d{4}|\d[ .-]\d{2}|\(at\)|\[at\]|\b[^\W\d_a-z]\w*,? \d|\d\w*,? [A-Z]")
    given = {g.lower() for g in GIVEN}
    pair = re.compile(r"\S [A-ZÀ-Þ][\w'’-]+,? [A-ZÀ-Þ]")
    for batch in pq.ParquetFile(path).iter_batches(20_000, columns=["posts", "lang"]):
        for text, lang in zip(batch["posts"].to_pylist(), batch["lang"].to_pylist()):
            for s in re.split(r"(?<=[.!?])\s+|\n", text or ""):
                # German nouns have capitals, so pairs of them say nothing there.
                words = {w.lower().strip(",.:;!?") for w in s.split()}
                if len(s) > 5 and not odd.search(s) and not words & given and ((lang or "").lower().startswith("de") or not pair.search(s)):
                    out.append(s)
        if len(out) >= 10 * most:
            break
    random.Random(seed).shuffle(out)
    return out[:most]


def labelled(make: Maker, around: list[str], least: int) -> tuple[str, list[int]]:
    """Made sentences between carriers, at least ``least`` characters."""
    r = make.r
    text, mark = make.sentence()
    while len(text) < least:
        s, t = make.sentence() if r.random() < 0.3 or not around else ((x := r.choice(around)), [0] * len(x))
        glue = r.choice([" ", " ", " ", "\n"])
        text, mark = (s + glue + text, t + [0] + mark) if r.random() < 0.5 else (text + glue + s, mark + [0] + t)
    case = r.random()
    other = text.upper() if case < 0.06 else text.lower() if case < 0.12 else text
    return (other, mark) if len(other) == len(text) else (text, mark)


def windows(around: list[str], size: int, seed: int = 7):
    """Endless batches of windows of text with their tags."""
    make = Maker(seed)
    while True:
        ids, tags = np.zeros((size, WIDTH), np.int16), np.zeros((size, WIDTH), np.int64)
        for i in range(size):
            text, mark = labelled(make, around, WIDTH + 40)
            # Most windows lie around a span.
            spots = [j for j, t in enumerate(mark) if t % 2]
            at = make.r.randint(0, len(text) - WIDTH) if not spots or make.r.random() < 0.3 else max(0, min(len(text) - WIDTH, make.r.choice(spots) - make.r.randint(0, WIDTH - 12)))
            ids[i], tags[i] = encode(text)[at : at + WIDTH], mark[at : at + WIDTH]
            if make.r.random() < 0.25:  # a text that is shorter than the window
                text, mark = make.sentence()
                text, mark = text[:WIDTH], mark[:WIDTH]
                ids[i], tags[i] = 0, 0
                ids[i, : len(text)], tags[i, : len(text)] = encode(text), mark
        yield ids, tags


def held_out(read, each: int = 40, seed: int = 99) -> dict[tuple[str, str], float]:
    """The share of spans found with their kind, by kind and language, in sentences of wording that training never saw."""
    make, out = Maker(seed), {}
    for lang, kinds in HELD_OUT.items():
        for kind, frames in kinds.items():
            texts, spans = [], []
            for i in range(each):
                before, after = frames.split("|")[i % 2].split("{}")
                span = getattr(make, kind)(lang)
                texts.append(before + span + after)
                spans.append((len(before), len(before) + len(span)))
            name = KINDS["EPIAN".index(kind)]
            hits = [any(k == name and a < hi and b > lo for k, a, b in found) for found, (lo, hi) in zip(read(texts), spans)]
            out[name, lang] = sum(hits) / each
    return out


def _round(job):
    """Some steps of one worker, from common weights, with its own moments and text."""
    w, state, around, seed, steps, rate = job
    return train(windows(around, 128, seed), w, rate, steps, state)


if __name__ == "__main__":
    import multiprocessing

    rounds, workers, each = int(sys.argv[3]) if len(sys.argv) > 3 else 20, 7, 100
    around = carriers(sys.argv[1])
    make = Maker(31)
    scorer = fit_scorer([labelled(make, around, 200) for _ in range(12_000)], say=lambda x: print(x, flush=True))
    w, first = new_weights(), 0
    if len(sys.argv) > 4:
        with np.load(sys.argv[4]) as f:
            w, first = {k: f[k].astype(np.float32) for k in f.files if not k.startswith("scorer_")}, rounds
    states = [None] * workers
    with multiprocessing.get_context("spawn").Pool(workers) as pool:
        for n in range(rounds):
            rate = (0.01 if not first else 0.004) * (1.02 - n / rounds)
            # The workers' weights are averaged after each round.
            done = pool.map(_round, [(w, states[i], around, 1000 * (first + n) + i, each, rate) for i in range(workers)])
            w = {k: np.mean([d[0][k] for d in done], 0, dtype=np.float32) for k in w}
            states = [d[1] for d in done]
            print(f"round {n + 1}: loss {np.mean([d[2] for d in done]):.3f}", flush=True)
            np.savez_compressed(sys.argv[2], **{k: v.astype(np.float16) for k, v in w.items()}, **scorer)
    print("kinds:", *KINDS)
