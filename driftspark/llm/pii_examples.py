"""Small labelled table of the personal-data model: [kind:span] marks a span, everything else is plain."""

EXAMPLES = """
please call [phone:(555) 123-4567] before noon
you can reach the office at [phone:555-867-5309] today
her phone is [phone:020 7946 0958] and she answers
tel [phone:0171 2345678] or write to the desk
my mobile number is [phone:07700 900123], thanks
fax [phone:1-800-555-0199] for the forms
contact us on [phone:415.555.2671] any time
ring [phone:(020) 7946-0018] and ask for the manager
phone: [phone:555 0142 987] in the evening
call [phone:+1 (212) 555-0187] or [phone:(212) 555-0188] now
tel. [phone:0033 1 42 68 53 00] in the morning
the mobile [phone:0151-2345-6789] is new
write to [email:anna.lee@mail.example.org] soon
mail [email:j_smith@example.com] for the notes
her address is [email:x99@corp.example.net].
send it to [email:sales@shop] today
contact [email:bob@localhost] on the old machine
email [email:maria@büro.example] for the keys
reach [email:first.last@host] or nobody
the host [ip:10.0.0.12] is down again
ping [ip:192.168.4.200] from the lab
server ip [ip:172.16.254.1] answers slowly
card [card:4111 1111 1111 1111] was charged
pay with [card:5500-0000-0000-0004] at the desk
the visa [card:4012888888881881] is valid
charge card number [card:3714 496353 98431] once
we met in 1998 and again in 2004 at the lake
the order 48213 has 12 boxes and 7 bags
version 2.0.1 of the tool came out in May
chapter 12.4 explains 3 of the 10 rules
on 2021-03-14 the shop sold 250 units
from 09:30 to 17:45 the room is open
the ratio is 0.875 and the sum is 1,234,567
page 233 line 14 of the report
it costs 19.99 or 24.50 with the case
room 404 on floor 3 is closed
see section 1.2.3.4.5 of the rules
license version 3 or version 2.0 applies
secret = "4f9a0c2d77b1e5a9034cc1" in the file
api_key = "9b2e7d41aa0c53f8e6d2b7719c04" was found
token = "a81bc81b9ff04e5d8c1e2d" is old
key = "0f3c55d2a9e84b7716" was leaked
the hash 5d41402abc4b2a76b9719d911017c592 differs
build 20240117.3 passed 118 tests
about 1500 people and 30 dogs came
isbn 978-3-16-148410-0 is on the shelf
the score was 21-14 and then 28-24
invoice 2023-00417 is paid
years 1914-1918 and 1939-1945 were studied
between 10 and 20 degrees at 1013 hPa
he ran 100m in 9.58 s and 200m in 19.19 s
part no. 883-221-09 fits model x200
sum of 12 34 56 78 is 180
a row of 1 2 3 4 5 6 7 8 9 numbers
the code 0000 and the code 1234 are weak
at 5 we start and at 7 we stop
copyright 2019 2020 2021 by the team
follow @anna or @bob_the_builder online
meet @ 7 pm near gate 12
the price @ 3.50 each is fair
mp3 and mp4 files of 128 kb and 320 kb
section 3.1 and table 12 list 45 items
the 3 2 1 start and the 10 9 8 countdown
id 883920174 was given to user 17
serial 1002-3344-5566 is printed below
the sample 10.1234.5678 was lost
""".strip().splitlines()
