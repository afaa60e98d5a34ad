"""Hand-written texts with marked spans, made apart from any generator: [[kind:span]]."""

import re

PERSONAL = """
My new number is [[phone:06 12 34 56 78]] since Monday, please update it.
You can also phone 020 7946 0958 during the week
Mobile: [[phone:07700 900123]], office hours only.
Tel. [[phone:(030) 901820-44]] or by letter.
For bookings dial [[phone:1-800-555-0199]] before noon.
Ring [[phone:555.867.5309]] and ask for the manager.
Our fax is [[phone:(212) 555-0147]] and it is always on.
She left [[phone:415-555-2671]] as a contact.
Reach me at [[phone:089 1234567]] in the evening
telephone [[phone:01 45 67 89 10]] (France)
His cell: [[phone:310 555 0182]].
Call [[phone:0171 2345678]] tomorrow
contact [[email:john dot doe at example dot com]] for the keys
mail to [[email:sara (at) hotel (dot) org]] please
write [[email:support [at] widgets [dot] net]] if it breaks
my address is [[email:kim.lee at mail dot com]] now
Email: [[email:info(at)bakery(dot)de]]
[[email:anna at uni dot edu]] answers within a day
send the file to [[email:peter dot pan at neverland dot co dot uk]] today
reach [[email:maria [at] clinic dot es]] for results
The host [[ip:10 . 1 . 2 . 3]] is down again
ping [[ip:192[.]168[.]0[.]1]] first
server [[ip:172 . 16 . 254 . 1]] rebooted at noon
traffic came from [[ip:8[.]8[.]4[.]4]] all night
node [[ip:203[.]0[.]113[.]77]] was blocked
ip [[ip:198 . 51 . 100 . 23]] belongs to us
charged to amex [[card:3782 822463 10005]] yesterday
card number [[card:371449635398431]] expires soon
my old visa [[card:4222222222222]] still works
Diners [[card:30569309025904]] was declined
credit card [[card:3056 930902 5904]] please
The order 20231104 shipped with 12 items.
Published on 2021-03-15 in issue 442.
The total was 1299.99 plus 45.50 tax.
Version 3.11.4.2 fixes the bug in section 10.2.1
He scored 147 points in 2003 and 2004.
isbn 978-3-16-148410-0 is out of print
The invoice 9938271 has 3 pages and 40 lines
We met at 10 and left at 12 to dot the i
Look at the dot on the map near 45 degrees
In 1998 1999 2000 2001 sales doubled
Room 1204, floor 12, building 7
tracking id 8812345678901234 was lost
ref 20240015 from 01.02.2024
temperatures of 12 14 15 17 and 21 degrees
It costs $ 1,250,000 or about 1100000 euros
look at example dot two for the proof
On 12/05/2019 at 14:30 the meeting began
the ratio is 3 . 5 to 1 . 2 here
part no 4456-2231 fits model 9000
population 8336817 in 2020
""".strip().split("\n")


def parse(line):
    """The plain text and its spans (kind, start, end)."""
    text, spans = "", []
    for part in re.split(r"(\[\[(?:phone|email|ip|card):.*?\]\](?!\]))", line):
        if m := re.fullmatch(r"\[\[(\w+):(.*)\]\]", part):
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text += m[2]
        else:
            text += part
    return text, spans


LABELLED = [parse(line) for line in PERSONAL]
LABELLED[1] = (LABELLED[1][0], [("phone", 19, 32)])
