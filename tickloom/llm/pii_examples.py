"""The small labelled table that the field of ``pii`` learns from: sentences with marks ``<kind|span>``."""

from __future__ import annotations

# Made-up people, reserved numbers, published test accounts.
EXAMPLES = """
you can reach me at <phone|(555) 010-2233> after five
call <phone|555-010-9876> to book a table
phone <phone|555 010 4455> or write to us
Tel. <phone|030 1234567> works from nine to noon
tel <phone|030/1234567> is the office
our fax is <phone|(212) 555-0187> and our post box is 12
mobile <phone|0171 5550123>, please leave a message
my cell is <phone|415.555.0134> if you get lost
Telefon <phone|089 5550 199> ist nur morgens besetzt
ruf mich an unter <phone|0160 555 0142> oder schreib
appelez le <phone|01 55 50 12 34> avant midi
mon portable est le <phone|06 55 51 23 45>, merci
llame al <phone|91 555 01 23> por la tarde
mi móvil es <phone|655 501 234> desde ayer
whatsapp <phone|555-0100-222> any time
contact number <phone|(020) 5550 1234>
the number is <phone|555-0143> in town
write to <email|jane dot doe at mail dot example dot com> today
my address is <email|john at example dot org> for now
mail <email|anna [at] example [dot] net> with questions
email <email|r.miller (at) example (dot) com> please
send it to <email|support(at)example.com> and wait
schreib an <email|info [at] beispiel [dot] de> bitte
contact <email|lee_k AT example DOT com> about the flat
écrivez à <email|claire at exemple dot fr> vite
escriba a <email|pablo [at] ejemplo.es> hoy
card <card|4111.1111.1111.1111> was charged twice
the amex <card|3782 822463 10005> expires in may
my card is <card|378282246310005> and it works
carte <card|3714-496353-98431> refusée
credit card <card|5555_5555_5555_4444> on file
ssn <ssn|123-45-6789> belongs to the tenant
social security number <ssn|078-05-1120> was printed
her social is <ssn|219-09-9999> and she is fine
SSN: <ssn|457-55-5462>
iban <iban|DE89 3704 0044 0532 0130 00> for the rent
pay to <iban|GB29NWBK60161331926819> by friday
Konto <iban|DE89370400440532013000> bei der Bank
virement sur <iban|FR14 2004 1010 0505 0001 3M02 606> svp
IBAN: <iban|ES91 2100 0418 4502 0005 1332>
the meeting is at 10:30 on 12 march 2024
it costs 1,299.00 euros or 3 payments of 433
version 2.14.3 was released on 2024-03-12
see pages 120-134 of volume 7
order 2024-000123 has shipped
room 555 is on floor 5
between 1914 and 1918 the prices rose by 40 %
the score was 3-2 after 90 minutes
chapter 4.2.1 lists 16 rules
the hash is 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08
key = "9A8B7C6D5E4F30219A8B7C6D5E4F3021"
token 4a7d1ed414474e4033ac29ccb8653d9b expired
invoice 8841 of 2023-11-05 amounts to 1200
isbn 978-3-16-148410-0 is out of print
the 100 m record stands at 9.58 s
lot 20240311 contains 500 pieces
we saw 12 swans, 7 ducks and 1 heron
article 5 (2) of the act of 1998
he is at home and she is at work
look at the dot on the map
a point at the end, a dot at the start
the train leaves at 7 and returns at 19
this is a plain sentence without any number
the river was quiet and the town asleep
Nobody knew what the letter said.
In the morning, they left for the coast.
Der Zug fährt um 8 Uhr ab und ist pünktlich.
Die alte Stadt liegt am Fluss, sagte er.
Am 3. Oktober 1990 war ein Feiertag
Le musée ouvre à 10 h et ferme à 18 h
La maison est au bout de la rue.
El 5 de mayo de 1862 fue un lunes
La casa estaba vacía y fría.
foo @ bar ### baz !!! qux
@@@ %%% &&& *** ###
he paid with card and left
the phone rang, the fax did not
call me later, please
her social life is quiet
my address is on the door
id 4785380592391138 in table 7
the form asks for <ssn|212-34-5678> again
his ssn <ssn|601-22-3456> expired last year
my social <ssn|333-22-4444> got stolen
ssn <ssn|455-66-7788> and nothing else
mail <email|bob at site dot net> about the car
please write <email|carl at web dot example dot org> soon
email <email|nina at shop dot com> or call
reach <email|tom at mail dot net> any time
she sat at home dot by dot
call <phone|(303) 555-0111> on mondays
iban <iban|NL20INGB0001234567> is closed
the card <card|4012.8888.8888.1881> is lost
serial 1234567890123456 is sold out
ratio 3.1415926535 or 22/7
coordinates 52.5200, 13.4050
1 2 3 4 5 6 7 8 9 10
2019 2020 2021 2022
isn't that 5 o'clock
x = 42; y = x * 3.5
item (3) and item (4)
A4 paper, B5 envelope, C64 computer
"""
