"""The labelled table that the personal-data model is trained on: sentences with their spans between brackets, [kind|text].

Fixed values: what is to be found, what only looks like it, and the words around both, in four languages.
"""

SENTENCES = (
    # mail addresses that are written out or broken up
    "Write to [email|anna.holm (at) example (dot) org] before noon.",
    "You can reach me via [email|j.smith [at] mail [dot] example [dot] com] or come by.",
    "contact: [email|peter AT example DOT net]",
    "My address is [email|maria dot lopez at example dot com] as always.",
    "Send it to [email|sales @ example.org] please.",
    "Mail [email|bob.jones @example.co.uk] for the key",
    "E-Mail: [email|info(at)beispiel.de] oder Telefon",
    "Schreiben Sie an [email|k.meyer (at) beispiel (punkt) de] bis Montag.",
    "Écrivez à [email|jean.dupont (arobase) exemple.fr] avant midi.",
    "Correo: [email|ana_ruiz [arroba] ejemplo [punto] es] o ven a vernos.",
    "Please mail [email|the_team{at}example{dot}io] with questions.",
    "his mail [email|x99 (at) example.com] bounced",
    "Questions to [email|m.brown [at] dept.example.edu] only.",
    "The office ([email|front-desk(at)example.org]) is open.",
    "Reply to [email|lee dot wong at mail dot example dot com] today.",
    # network addresses that are broken up
    "The host [ip|192[.]168[.]10[.]4] was blocked.",
    "Traffic from [ip|10(.)0(.)0(.)12] rose again.",
    "ping [ip|172 . 16 . 254 . 1] failed twice",
    "Beaconing to [ip|203[.]0[.]113[.]77] over port 443.",
    "address [ip|8[dot]8[dot]4[dot]4] answers",
    "seen at [ip|198[.]51[.]100[.]23] since May",
    "The log names [ip|10 . 1 . 2 . 250] as the client.",
    # cards, where the words say that it is one
    "Card number: [card|4556 7375 8689 9855 ] and the code is on the back.",
    "My visa is [card|4929.1234.5678.9012], valid until 09/27.",
    "Kartennummer: [card|5500 0000 0000 0013] bitte belasten.",
    "Numéro de carte : [card|4970 1012 3456 7899] à débiter.",
    "Tarjeta: [card|5105 1051 0510 5110] caduca en mayo.",
    "credit card [card|4111/1111/1111/1112] was declined",
    "pay with mastercard [card|5424-1802-7979-1733] now",
    "Charged to card [card|4000.0012.3456.7890] yesterday.",
    "visa [card|4012888888881882] exp 10/26",
    "card no. [card|6011000990139425] on file",
    # telephone numbers without a plus sign in front
    "Call [phone|(437) 555-0689] after six.",
    "Phone: [phone|437-555-0142] or write.",
    "Tel. [phone|0047 22 33 44 55], ask for Kari.",
    "tel [phone|(212) 555 0199]",
    "Telefon: [phone|030 / 901820] bis 18 Uhr.",
    "Tél. [phone|01 42 68 53 00] le matin.",
    "Teléfono: [phone|91 123 45 67] por la tarde.",
    "call me at [phone|555-867-5309] tonight",
    "Ring [phone|020 7946 0958] for the desk.",
    "mobile [phone|07700 900123] works best",
    "fax: [phone|(020) 7946-0123]",
    "His cell is [phone|303.555.0175] now.",
    "Dial [phone|1-800-555-0111] for help.",
    "Handy: [phone|0171 2345678] abends.",
    "You may phone [phone|(617) 555-0134] and leave word.",
    "or text [phone|415 555 0132] any time",
    "elle est. Des [phone|+1 (826) 555-4081] 190.137.223.204 du an",
    "[phone|+1 (843) 555-7672] 7417225527245 et la",
    "ring [phone|+47 22 33 44 55] 2024-05-17 or so",
    # names after a title or an introduction
    "We met Mr. [name|John Smith] at the door.",
    "Ask Mrs [name|Helen O'Brien] about it.",
    "Dr. [name|Maria Lopez] signed the form.",
    "Prof. [name|Li Wei] teaches there.",
    "My name is [name|Anna Holm] and I live here.",
    "Herr [name|Klaus Meyer] ist heute nicht da.",
    "Frau [name|Ingrid Schulz] kommt um 9 Uhr.",
    "Mme [name|Claire Dupont] est absente.",
    "Monsieur [name|Jean Moreau] arrive à 10 h.",
    "Señora [name|Carmen Ruiz] vive en Madrid.",
    "Ms. [name|Jane Doe] called twice.",
    "Name: [name|Peter Jones]\nAge 44",
    "Mr [name|Brown] said no.",
    "my name is [name|Tom] .",
    # numbers and words that are nothing of the kind
    "The meeting is on 2024-05-17 at 10:30 in room 214.",
    "Prices rose by 3.5 % to 1,299.00 dollars in 2023.",
    "See section 4.2.17 of the manual, page 118.",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under CC BY-NC 4.0.",
    "token = \"dafbac99949115180e7593de87b4492bcef9890b\"",
    "secret = \"59ea3612aa6fdb1d4556ccac234e5419878f26bc\" was set",
    "commit 9d04c80004c73dc9e548fee51b23b527780d4f20 broke it",
    "hash 44a0f5b6efd1d1e39ce85077a264c4ecb29ba073 and 2 more",
    "the total was 1142126282388588 in all",
    "near 4264645872074223 for a while",
    "ent 2353820953013749 4550997810720808 the",
    "ID 7417225527245 and 4668799872880521 are keys",
    "an order of 250 pieces, 12 x 40 cm",
    "between 1914 and 1918, and again 1939 to 1945",
    "Chapter 12. The 3 bears ate 14 bowls.",
    "At 5 pm the score was 21-17.",
    "ISBN 978-3-16-148410-0 is out of print.",
    "Invoice 20231105-0042 is due in 30 days.",
    "Order no. 100-2345-77 left on 05/06/2022.",
    "version 10.15.7 build 19H2 is out",
    "The ratio is 16:9, or 1.78 to 1.",
    "x = 3 ; y = 44 ; z = 120",
    "row 1 | 22 | 333 | 4444 |",
    "1. first 2. second 3. third",
    "Article 6 (1) (a) and Annex 3 apply.",
    "temperatures of 20 - 25 degrees at 1013 hPa",
    "Am 3. Mai 2021 um 14.30 Uhr in Raum 12.",
    "Le 14 juillet 1789, vers 17 h 30.",
    "El 12 de octubre de 1492, unas 90 personas.",
    "Population 5 391 369 in 2020 ; area 385 207 km",
    "@ the end of the day",
    "follow @someone and @other_one on the site",
    "we meet at noon and dot the i",
    "put a dot at the end of it",
    "He was at home. Dot was there, too.",
    "The Mr. in the title is a joke.",
    "a Dr. should look at it",
    "Herr der Ringe ist ein Buch.",
    "Tel Aviv has 460,613 people.",
    "The card game needs 52 cards and 2 jokers.",
    "visa rules changed in 2019 for 27 states",
    "phone sales fell 12 % in 2022",
    "call number 5 in the queue of 31",
    "IP law of 1998, part 4",
    "host 12 of 48 is down since 03:15",
    "!!! 5927243074273351 !!!",
    "the % 42 $ 17 # 3 & 8",
    "lot 0047 , box 22 , shelf 33",
    "1 2 3 4 5 6 7 8 9 10 11 12",
    "44 555 is not 0689 nor 12",
    "from 100 to 200 in 5 steps of 20",
    "blend. By a hand. 9000426309966103 $$ and then",
    "et la. Éque ouch 12 le. Ait Ver un 4264645872074223 mot",
    "of it. *** 9000426309966103 *** Hein an",
    "that. And the. The was 9890149938096983 Hein an the",
    "&&& 1142126282388583 $$$ the %%%",
    "Enat. Errent ha 33 or. Ou in",
    "| or | 1234567890123451 | sh . | In | 20 |\nLicens",
    "lich.\nDer und 4928819459423837\nFor as be",
    "1232810148878562\n4492936784912310\n",
    "Rr ci. Ue. Quear del 38 ion 6717306450380461 que",
    "A 16 B 7 Cd 9 Ef. Gh 10",
    "latitude 59.9139 and longitude 10.7522",
)
